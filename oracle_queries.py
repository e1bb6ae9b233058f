"""SQL counterparts of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

VISITS = """visits AS (
  SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, CAST(l_partkey AS VARCHAR) AS icd_code,
         dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS admit_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

HIER = """hier AS (
  SELECT icd_code, icd_desc, ccs_code, ccs_desc, ccs1_code, ccs1_desc, ccs2_code, ccs2_desc, icd_chp_code, icd_chp_desc,
         icd_code || ' - ' || icd_desc AS icd, icd_chp_code || ' - ' || icd_chp_desc AS icd_c,
         ccs_code || ' - ' || ccs_desc AS ccs_s, ccs1_code || ' - ' || ccs1_desc AS ccs1, ccs2_code || ' - ' || ccs2_desc AS ccs2
  FROM (SELECT CAST(p_partkey AS VARCHAR) AS icd_code, p_name || ' #' || p_partkey AS icd_desc,
               replace(p_brand, 'Brand#', '') AS ccs_code, p_brand AS ccs_desc, p_type AS ccs1_code, lower(p_type) AS ccs1_desc,
               p_type || '.' || replace(p_brand, 'Brand#', '') AS ccs2_code, lower(p_type) || ' ' || p_brand AS ccs2_desc,
               CAST((p_size - 1) // 10 + 1 AS VARCHAR) AS icd_chp_code,
               'size band ' || ((p_size - 1) // 10 + 1) AS icd_chp_desc
        FROM part))"""

FANNED = """secondary AS (
  SELECT CAST(p_partkey AS VARCHAR) AS code, CAST(n_regionkey AS VARCHAR) AS snomed_code FROM part JOIN nation ON p_size = n_nationkey
  UNION ALL
  SELECT CAST(p_partkey AS VARCHAR), 'R' || n_regionkey FROM part JOIN nation ON p_size = n_nationkey),
fanned AS (SELECT hier.*, snomed_code FROM hier LEFT JOIN secondary ON code = icd_code)"""

PEOPLE = """people AS (
  SELECT c_custkey AS subject_id, c_mktsegment AS segment, n_name AS nation, r_name AS region
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

COHORTS = """tidy AS (SELECT * FROM visits JOIN hier USING (icd_code)),
base AS (SELECT DISTINCT subject_id FROM tidy WHERE ccs1_code = 'PROMO' AND admit_id > 1),
plus AS (SELECT subject_id FROM base WHERE subject_id IN (SELECT subject_id FROM tidy WHERE ccs_code = '7')),
minus AS (SELECT subject_id FROM base WHERE subject_id NOT IN (SELECT subject_id FROM tidy WHERE ccs_code = '7'))"""

COHORT = f"WITH {VISITS}, {HIER}, {COHORTS}, {PEOPLE}"

ADVERSE = """indication AS (
  SELECT coalesce(CASE WHEN c_acctbal >= 0 THEN c_custkey END, c_custkey) AS subject_id, c_mktsegment AS indi_desc,
         CAST(c_nationkey AS BIGINT) AS indication_concept_id,
         CASE WHEN c_acctbal < 9000 THEN CAST(c_nationkey AS BIGINT) END AS indi_snomed_id
  FROM customer WHERE c_acctbal < 9000),
chosen AS (SELECT DISTINCT subject_id FROM indication WHERE regexp_matches(indi_desc, 'AUTO|BUILD')),
drug AS (
  SELECT o_custkey AS subject_id, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS drug_seq, l_partkey AS drug_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
nations AS (
  SELECT 'N' || n_nationkey AS icd_code, CAST(r_regionkey AS VARCHAR) AS ccs_code, r_name AS ccs_desc, CAST(n_nationkey AS VARCHAR) AS snomed_code
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT 'R' || r_regionkey, CAST(r_regionkey AS VARCHAR), r_name, CAST(n_nationkey AS VARCHAR)
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

ADVERSE_VISITS = """outcome AS (
  SELECT o_custkey AS subject_id, l_partkey AS drug_id, l_suppkey AS outcome_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
usable AS (
  SELECT outcome_id FROM (SELECT DISTINCT outcome_id FROM outcome) JOIN supplier ON s_suppkey = outcome_id
  JOIN nations ON snomed_code = CAST(s_nationkey AS VARCHAR)),
a1 AS (SELECT outcome.* FROM outcome JOIN usable USING (outcome_id) WHERE subject_id IN (SELECT subject_id FROM chosen)),
a2 AS (SELECT subject_id, drug_id, outcome_id, drug_seq FROM a1 JOIN drug USING (subject_id, drug_id)),
a3 AS (
  SELECT subject_id, drug_seq, icd_code FROM a2 JOIN supplier ON s_suppkey = outcome_id
  JOIN nations ON snomed_code = CAST(s_nationkey AS VARCHAR)),
outcome_visits AS (SELECT *, dense_rank() OVER (ORDER BY drug_seq) AS admit_id FROM a3)"""

ADVERSE_STUDY = f"""WITH {ADVERSE}, {ADVERSE_VISITS},
known AS (SELECT * FROM nations WHERE ccs_desc <> 'EUROPE'),
pairs AS (
  SELECT subject_id, dense_rank() OVER (ORDER BY drug_seq) AS admit_id, indi_desc, CAST(s_suppkey AS VARCHAR) AS snomed_code
  FROM drug JOIN indication USING (subject_id) LEFT JOIN supplier ON s_suppkey = indi_snomed_id
  WHERE subject_id IN (SELECT subject_id FROM chosen)),
selection AS (SELECT * FROM pairs JOIN known USING (snomed_code) WHERE regexp_matches(indi_desc, 'AUTO')),
cohort AS (
  SELECT DISTINCT subject_id FROM selection WHERE icd_code = 'R2' AND admit_id > 1
  AND subject_id NOT IN (SELECT subject_id FROM selection WHERE icd_code = 'N7')),
coded AS (
  SELECT subject_id, admit_id, coalesce(ccs_code, '999999') AS item, coalesce(ccs_desc, '999999') AS condition
  FROM outcome_visits LEFT JOIN known USING (icd_code))"""

DEATHS = """deaths AS (
  SELECT *, CASE WHEN record IS NULL THEN entity ELSE entity || ' 03 ' || record END AS multiple_causes
  FROM (
    SELECT o_orderkey, substr(o_orderpriority, 1, 1) AS res_status, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS education_89,
           substr(c_mktsegment, 1, 1) AS sex, substr(c_mktsegment, 2, 1) AS marital,
           CASE WHEN o_orderstatus <> 'P' THEN substr(CAST(month(o_orderdate) AS VARCHAR), 1, 1) END AS education_03,
           lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') AS age_group,
           CASE WHEN o_orderstatus <> 'O' THEN lpad(CAST(day(o_orderdate) AS VARCHAR), 2, '0') END AS age_infant,
           CAST(year(o_orderdate) AS VARCHAR) AS data_year, 'C' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS underlying_cause,
           lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS race, substr(o_orderpriority, 1, 1) AS hispanic_recode,
           'S' || o_orderstatus || '1 P' || substr(o_orderpriority, 1, 1) || '0' AS entity,
           CASE o_orderstatus
             WHEN 'F' THEN 'C' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || ' P' || substr(o_orderpriority, 1, 1) || '0 SF1'
             WHEN 'P' THEN 'P' || substr(o_orderpriority, 1, 1) || '0 C' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || ' C' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0')
           END AS record
    FROM orders JOIN customer ON o_custkey = c_custkey)),
axes AS (SELECT *, regexp_split_to_array(multiple_causes, '\\s\\d{2}\\s') AS parts FROM deaths),
death_visits AS (
  SELECT o_orderkey AS subject_id, 1 AS admit_id, underlying_cause AS codes FROM deaths
  UNION ALL
  SELECT o_orderkey, 2, trim(regexp_replace(parts[2], underlying_cause, '')) FROM axes),
packed_deaths AS (
  SELECT subject_id, admit_id, replace(replace(codes, ' ', ','), ',,', ',') AS icd_code FROM death_visits WHERE codes <> '')"""

# how often each basket item stands in a visit is irrelevant to mining; `occ` holds (subject, visit, state)
NEXT = """total AS (SELECT count(DISTINCT subject_id) AS n FROM occ),
least AS (SELECT ceil(round({support} * n, 9)) AS hits FROM total),
usual AS MATERIALIZED (SELECT o.* FROM occ o WHERE state IN (
  SELECT state FROM occ GROUP BY state HAVING count(DISTINCT subject_id) >= (FROM least))),
marks AS (SELECT DISTINCT subject_id, visit FROM usual),
following AS MATERIALIZED (
  SELECT m.subject_id, m.visit AS at, o.state, min(o.visit) AS visit
  FROM marks m JOIN usual o ON o.subject_id = m.subject_id AND o.visit > m.visit GROUP BY ALL)"""


def _mined(occ: str, support: float, depth: int) -> str:
    """All sequences that enough subjects hold, level by level from the frequent ones; the last level has none.

    Sequences are numbers within a level: ``f`` names what each extends (``parent``), its last state, and the sequence left without
    its first state (``tail``), which has to be frequent too; ``r`` has the first end of each in every subject.
    """
    steps = ["""f1 AS MATERIALIZED (SELECT row_number() OVER () AS id, 0 AS parent, 0 AS tail, state, [state] AS p, hits
  FROM (SELECT state, count(DISTINCT subject_id) AS hits FROM usual GROUP BY state)),
r1 AS MATERIALIZED (SELECT subject_id, id, min(visit) AS e FROM usual JOIN f1 USING (state) GROUP BY subject_id, id),
c2 AS MATERIALIZED (SELECT a.id AS parent, b.state, b.id AS tail FROM f1 a, f1 b)"""]
    for k in range(2, depth + 2):
        if k > 2:
            steps.append(f"c{k} AS MATERIALIZED (SELECT a.id AS parent, b.state, b.id AS tail FROM f{k - 1} a JOIN f{k - 1} b ON b.parent = a.tail)")
        steps.append(f"""g{k} AS MATERIALIZED (SELECT r.subject_id, r.id AS parent, n.state, n.visit AS e
  FROM r{k - 1} r JOIN following n ON n.subject_id = r.subject_id AND n.at = r.e JOIN c{k} c ON c.parent = r.id AND c.state = n.state),
f{k} AS MATERIALIZED (SELECT row_number() OVER () AS id, h.parent, c.tail, h.state, list_append(f.p, h.state) AS p, h.hits
  FROM (SELECT parent, state, count(*) AS hits FROM g{k} GROUP BY parent, state HAVING count(*) >= (FROM least)) h
  JOIN c{k} c ON c.parent = h.parent AND c.state = h.state JOIN f{k - 1} f ON f.id = h.parent),
r{k} AS MATERIALIZED (SELECT g.subject_id, f.id, g.e FROM g{k} g JOIN f{k} f ON f.parent = g.parent AND f.state = g.state)""")
    levels = ",\n".join(steps)
    counted = " UNION ALL ".join(f"SELECT p, hits FROM f{k}" for k in range(1, depth + 2))
    return f"""occ AS ({occ}),
{NEXT.format(support=support)},
{levels},
mined AS MATERIALIZED (
  SELECT p, array_to_string(p, ' => ') AS sequence, hits / n AS support, len(p) AS length
  FROM ({counted}), total)"""


TYPES = "SELECT DISTINCT subject_id, admit_id AS visit, ccs1_code AS state FROM visits JOIN hier USING (icd_code)"
BRANDS = "SELECT DISTINCT subject_id, admit_id AS visit, ccs_code AS state FROM visits JOIN hier USING (icd_code)"
MINED_TYPES = f"WITH {VISITS}, {HIER}, {_mined(TYPES, 0.6, 5)}"
MINED_BRANDS = f"WITH {VISITS}, {HIER}, {_mined(BRANDS, 0.2, 5)}"


def _flag_tables(n: str = "(SELECT least(max(len(p)), 8) FROM mined)") -> str:
    """Flags by looking at every pair of positions, unpadded and padded to ``n`` states."""
    # a plain pattern is found where it is contained; only others are compiled
    finds = "CASE WHEN regexp_full_match({b}, '[A-Za-z0-9 #]*') THEN contains({a}, {b}) ELSE regexp_matches({a}, {b}) END"
    either = f"({finds.format(a='c[i]', b='c[j]')} OR {finds.format(a='c[j]', b='c[i]')})"
    inside = f"""CASE WHEN mode = 'documented' THEN c[i] <> c[j] AND (contains(c[i], c[j]) OR contains(c[j], c[i]))
                   WHEN n = 7 AND i = 3 AND j = 7 THEN c[i] <> c[j] AND {finds.format(a='c[i]', b='c[j]')}
                   WHEN n = 7 AND i = 2 AND j = 7 THEN c[2] <> c[6] AND {either}
                   ELSE c[i] <> c[j] AND {either} END"""
    near = "list_filter(range(1, n), lambda i: {})"
    far = "list_filter(range(1, n), lambda i: len(list_filter(range(i + 2, n + 1), lambda j: {})) > 0)"
    return f"""width AS (SELECT {n} AS w),
cells AS MATERIALIZED (
  SELECT sequence, 'documented' AS mode, p AS c, CAST(len(p) AS BIGINT) AS n FROM mined
  UNION ALL
  SELECT sequence, 'padded', list_concat(p[1:8], list_resize(CAST([] AS VARCHAR[]), greatest(w - len(p), 0), '0')), CAST(w AS BIGINT) FROM mined, width),
found AS MATERIALIZED (
  SELECT sequence, mode, len({near.format("c[i] = c[i + 1] AND NOT (mode = 'padded' AND c[i] = '0')")}) > 0 AS consec,
         len({far.format("c[i] = c[j] AND NOT (mode = 'padded' AND n = 4 AND i = 1 AND j = 4)")}) > 0 AS non_consec,
         len({near.format(f"len(list_filter([i + 1], lambda j: {inside})) > 0")}) > 0 AS embed_consec,
         len({far.format(inside)}) > 0 AS embed_non_consec
  FROM cells),
flags AS (
  SELECT sequence, mode, CAST(consec AS INT) AS consec, CAST(non_consec AND NOT consec AS INT) AS non_consec,
         CAST(embed_consec AS INT) AS embed_consec, CAST(embed_non_consec AND NOT embed_consec AS INT) AS embed_non_consec
  FROM found)"""


def _paths(day: str = "CAST(ts AS DATE)") -> str:
    return f"""mined AS MATERIALIZED (
  SELECT p, array_to_string(p, ' => ') AS sequence FROM (
    SELECT DISTINCT list(n ORDER BY day) AS p FROM (
      SELECT user_id, {day} AS day, CAST(count(*) AS VARCHAR) AS n FROM events GROUP BY ALL) GROUP BY user_id))"""


FLAGS = "SELECT * FROM flags"


DESCRIBED = f"""{MINED_TYPES},
names AS (SELECT DISTINCT ccs1_code, CASE ccs1_code WHEN 'ECONOMY' THEN 'Unclassified goods' ELSE ccs1_desc END AS d FROM hier),
kept AS (SELECT *, unnest(p) AS code, generate_subscripts(p, 1) AS pos FROM mined WHERE length >= 2 AND len(list_distinct(p)) = length),
described AS (
  SELECT sequence, support, list(d ORDER BY pos) AS states FROM kept LEFT JOIN names ON code = ccs1_code GROUP BY sequence, support)"""


def _rules(items: str, support: float, confidence: float) -> str:
    """All item sets of every transaction, counted; rules with one item on the right."""
    return f"""txn AS ({items}),
total AS (SELECT count(DISTINCT (subject_id, admit_id)) AS n FROM txn),
subsets AS (
  SELECT subject_id, admit_id, [item] AS s FROM txn
  UNION ALL
  SELECT u.subject_id, u.admit_id, list_append(u.s, t.item)
  FROM subsets u JOIN txn t ON t.subject_id = u.subject_id AND t.admit_id = u.admit_id AND t.item > u.s[-1]),
sets AS (SELECT s, count(*) AS hits FROM subsets GROUP BY s),
frequent AS (SELECT s, hits FROM sets, total WHERE hits >= ceil(round({support} * n, 9))),
whole AS (SELECT s, hits, unnest(s) AS c FROM frequent WHERE len(s) BETWEEN 2 AND 10),
rules AS (
  SELECT array_to_string(a.s, ',') AS antecedent, w.c AS consequent, w.hits / a.hits AS raw_confidence,
         w.hits / a.hits / (r.hits / n) AS raw_lift, w.hits / n AS raw_support
  FROM whole w JOIN frequent a ON a.s = list_filter(w.s, lambda x: x <> w.c) JOIN frequent r ON r.s = [w.c], total
  WHERE w.hits / a.hits >= {confidence} - 1e-9),
flat AS (SELECT antecedent, consequent, round(raw_confidence, 9) AS confidence, round(raw_lift, 9) AS lift, round(raw_support, 9) AS support FROM rules)"""


TYPE_ITEMS = "SELECT DISTINCT subject_id, admit_id, ccs1_desc AS item FROM visits JOIN hier USING (icd_code)"
TYPE_RULES = f"WITH RECURSIVE {VISITS}, {HIER}, {_rules(TYPE_ITEMS, 0.02, 0.3)}"



def _clustered(k: int, rounds: int) -> str:
    """Left sides of ``flat`` by k-means in whole numbers, every distance worked out over full rows."""
    distance = "list_sum(list_transform(list_zip(p.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
    steps = ["""lefts AS (SELECT DISTINCT antecedent AS lhs FROM flat), rights AS (SELECT DISTINCT consequent AS rhs FROM flat),
points AS MATERIALIZED (
  SELECT l.lhs, list(CAST(round((coalesce(f.raw_lift, 1) - 1) * 1000000) AS HUGEINT) ORDER BY r.rhs) AS v
  FROM lefts l CROSS JOIN rights r LEFT JOIN rules f ON f.antecedent = l.lhs AND f.consequent = r.rhs GROUP BY l.lhs)""",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256(lhs), lhs) - 1 AS k, v FROM points QUALIFY k < {k})"""]
    for t in range(rounds + 1):
        steps.append(f"""a{t} AS MATERIALIZED (SELECT lhs, min(k) AS k FROM (
  SELECT p.lhs, c.k, {distance} AS d, min(d) OVER (PARTITION BY p.lhs) AS least FROM points p CROSS JOIN c{t} c) WHERE d = least GROUP BY lhs)""")
        if t < rounds:
            steps.append(f"""c{t + 1} AS MATERIALIZED (SELECT o.k, coalesce(m.v, o.v) AS v FROM c{t} o LEFT JOIN (
  SELECT k, list((s - ((s % n + n) % n)) // n ORDER BY i) AS v FROM (
    SELECT k, i, sum(e) AS s, count(*) AS n FROM (SELECT a.k, unnest(p.v) AS e, unnest(range(len(p.v))) AS i FROM points p JOIN a{t} a USING (lhs)) GROUP BY k, i)
  GROUP BY k) m USING (k))""")
    return ",\n".join(steps)


BOUNDED_RULES = """WITH kinds AS (SELECT p_partkey, p_type || CASE WHEN p_size > 25 THEN ' large' ELSE ' small' END AS item FROM part),
bought AS (SELECT DISTINCT o_custkey AS txn, item FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN kinds ON l_partkey = p_partkey),
numbers AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS i FROM (SELECT DISTINCT item FROM bought)),
masks AS MATERIALIZED (SELECT mask, count(*) AS w FROM (SELECT txn, bit_or(CAST(1 AS BIGINT) << i) AS mask FROM bought JOIN numbers USING (item) GROUP BY txn) GROUP BY mask),
total AS (SELECT sum(w) AS n FROM masks),
sets AS MATERIALIZED (
  SELECT s, sum(w) AS hits FROM (SELECT unnest(range(1, (SELECT CAST(1 AS BIGINT) << count(*) FROM numbers))) AS s) JOIN masks ON mask & s = s
  WHERE bit_count(s) <= 10 GROUP BY s HAVING sum(w) >= (SELECT ceil(round(0.3 * n, 9)) FROM total)),
names AS (SELECT s, array_to_string(list(item ORDER BY item), ',') AS items FROM sets JOIN numbers ON (s >> i) & 1 = 1 GROUP BY s)
SELECT names.items AS antecedent, numbers.item AS consequent, round(w.hits / a.hits, 9) AS confidence,
       round(w.hits / a.hits / (r.hits / n), 9) AS lift, round(w.hits / n, 9) AS support
FROM sets w JOIN numbers ON (w.s >> i) & 1 = 1 JOIN sets a ON a.s = w.s - (CAST(1 AS BIGINT) << i) JOIN names ON names.s = a.s
     JOIN sets r ON r.s = CAST(1 AS BIGINT) << i, total
WHERE w.hits / a.hits >= 0.8 - 1e-9"""

RAW_LEVELS = """raw AS (
  SELECT CAST(p_partkey AS VARCHAR) AS icd_code, p_type AS c1, lower(p_type) || ' goods [ ' || p_size || '.], all' AS d1,
         CASE WHEN p_size > 10 THEN p_brand END AS c2, CASE WHEN p_size > 15 THEN p_brand || ', [x] and [y]' END AS d2,
         CASE WHEN p_size > 25 THEN substr(p_name, 1, 3) END AS c3, CASE WHEN p_size > 20 THEN p_name END AS d3,
         CASE WHEN p_size > 40 THEN CAST(p_size AS VARCHAR) END AS c4, CASE WHEN p_size > 45 THEN 'size ' || p_size END AS d4
  FROM part),
levels AS (
  SELECT icd_code, c1 AS lvl1_cd, replace(regexp_replace(d1, '\\[.*\\]', '', 'g'), ',', '') AS lvl1_desc,
         coalesce(c2, c1) AS lvl2_cd, replace(regexp_replace(coalesce(d2, d1), '\\[.*\\]', '', 'g'), ',', '') AS lvl2_desc,
         coalesce(c3, c2, c1) AS lvl3_cd, replace(regexp_replace(coalesce(d3, d2, d1), '\\[.*\\]', '', 'g'), ',', '') AS lvl3_desc,
         coalesce(c4, c3, c2, c1) AS lvl4_cd, replace(regexp_replace(coalesce(d4, d3, d2, d1), '\\[.*\\]', '', 'g'), ',', '') AS lvl4_desc
  FROM raw)"""

BRIDGE = """bridge AS (
  SELECT CAST(p_partkey AS VARCHAR) AS icd_code, p_name AS icd_desc, CAST(p_size AS VARCHAR) AS snomed_code, p_brand AS snomed_desc FROM part
  UNION ALL
  SELECT CAST(p_partkey AS VARCHAR), p_name, 'N' || n_nationkey, n_name FROM part JOIN nation ON p_size = n_nationkey)"""

ICD10_CODES = """codes AS (
  SELECT substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', p_size % 26 + 1, 1)
         || lpad(CAST(CAST(replace(p_brand, 'Brand#', '') AS INT) * 4 - 1 AS VARCHAR), 2, '0')
         || CASE WHEN p_size > 26 THEN right(CAST(p_partkey AS VARCHAR), 1) ELSE '' END AS code, p_name, p_brand, p_type
  FROM part),
bounds(number, low, high, raw_low, raw_high, descr) AS (VALUES
  (1, 'A00', 'B99', '', 'B99', 'certain infectious and parasitic diseases'), (2, 'C00', 'D48', 'C00', 'D48', 'neoplasms'),
  (3, 'D50', 'D89', 'D50', 'D89', 'diseases of the blood and blood-forming organs and certain disorders involving the immune mechanism'),
  (4, 'E00', 'E90', 'E00', 'D90', 'endocrine, nutritional and metabolic diseases'),
  (5, 'F00', 'F99', 'F00', 'F99', 'mental and behavioral disorders'), (6, 'G00', 'G99', 'G00', 'G99', 'Diseases of the nervous system'),
  (7, 'H00', 'H59', 'H00', 'H59', 'diseases of the eye and adnexa'), (8, 'H60', 'H95', 'H60', 'H95', 'diseases of the ear and mastoid process'),
  (9, 'I00', 'I99', 'I00', 'I99', 'diseases of the circulatory system'), (10, 'J00', 'J99', 'J00', 'J99', 'diseases of the respiratory system'),
  (11, 'K00', 'K93', 'K00', 'K93', 'diseases of the digestive system'),
  (12, 'L00', 'L99', 'L00', 'L99', 'diseases of the skin and subcutaneous tissue'),
  (13, 'M00', 'M99', 'M00', 'M99', 'diseases of the musculoskeletal system and connective tissue'),
  (14, 'N00', 'N99', 'N00', 'N99', 'diseases of the genitourinary system'),
  (15, 'O00', 'O99', 'O00', 'O99', 'pregnancy, childbirth and the puerperium'),
  (16, 'P00', 'P96', 'P00', 'P96', 'certain conditions originating in the perinatal period'),
  (17, 'Q00', 'Q99', 'Q00', 'Q99', 'congenital malformations, deformations and chromosomal abnormalities'),
  (18, 'R00', 'R99', 'R00', 'R99', 'symptoms, signs and abnormal clinical and laboratory findings, not elsewhere classified'),
  (19, 'S00', 'T98', 'S00', 'T98', 'injury, poisoning and certain other consequences of external causes'),
  (20, 'V01', 'Y98', 'V01', 'Y98', 'external causes of morbidity and mortality'),
  (21, 'Z00', 'Z99', 'Z00', 'Z99', 'factors influencing health status and contact with health services'),
  (22, 'U00', 'U99', 'U00', 'U99', 'codes for special purposes')),
placed AS (
  SELECT codes.*, mode, CAST(number AS VARCHAR) AS icd_chp_code, descr AS icd_chp_desc
  FROM codes CROSS JOIN (VALUES ('documented'), ('raw')) m(mode)
  LEFT JOIN bounds ON CASE mode WHEN 'raw' THEN code BETWEEN raw_low AND raw_high ELSE substr(code, 1, 3) BETWEEN low AND high END)"""

# fixed values: code books of the death records
BOOKS = """books(col, k, label) AS (VALUES
  ('res', '1', 'resident'), ('res', '2', 'nonresident_intrastate'), ('res', '3', 'nonresident_interterritory'), ('res', '4', 'foreign_resident'),
  ('e89', '00', 'no_education'), ('e89', '01', '1'), ('e89', '02', '2'), ('e89', '03', '3'), ('e89', '04', '4'), ('e89', '05', '5'),
  ('e89', '06', '6'), ('e89', '07', '7'), ('e89', '08', '8'), ('e89', '09', '9'), ('e89', '10', '10'), ('e89', '11', '11'), ('e89', '12', '12'),
  ('e89', '13', 'college1'), ('e89', '14', 'college2'), ('e89', '15', 'college3'), ('e89', '16', 'college4'), ('e89', '17', 'college5+'), ('e89', '99', 'not_stated'),
  ('e03', '1', 'k8'), ('e03', '2', '9-12'), ('e03', '3', 'highschool_ged'), ('e03', '4', 'some_college'), ('e03', '5', 'associate'),
  ('e03', '6', 'bachelors'), ('e03', '7', 'masters'), ('e03', '8', 'phd'), ('e03', '9', 'unknown'),
  ('age', '01', 'infant'), ('age', '02', '1-4'), ('age', '03', '5-14'), ('age', '04', '15-24'), ('age', '05', '25-34'), ('age', '06', '35-44'),
  ('age', '07', '45-54'), ('age', '08', '55-64'), ('age', '09', '65-74'), ('age', '10', '75-84'), ('age', '11', '85+'), ('age', '12', 'NotStated'),
  ('inf', NULL, 'NotInfantNotStated'), ('inf', '09', 'days7-13'), ('inf', '18', 'months7'), ('inf', '11', 'days21-27'), ('inf', '13', 'months2'),
  ('inf', '16', 'months5'), ('inf', '14', 'months4'), ('inf', '02', 'hours1-23'), ('inf', '15', 'months4'), ('inf', '07', 'days5'), ('inf', '03', 'days1'),
  ('inf', '22', 'months11'), ('inf', '12', 'months1'), ('inf', '01', 'under1hour'), ('inf', '04', 'days2'), ('inf', '10', 'days14-20'), ('inf', '06', 'days4'),
  ('inf', '17', 'months6'), ('inf', '08', 'days6'), ('inf', '05', 'days3'), ('inf', '19', 'months8'), ('inf', '21', 'months10'), ('inf', '20', 'months9'),
  ('race', '01', 'White'), ('race', '03', 'AmericanIndian'), ('race', '07', 'Filipino'), ('race', '05', 'Japanese'), ('race', '02', 'Black'), ('race', '28', 'Korean'),
  ('race', '68', 'OtherAsianPacificIslander'), ('race', '38', 'Samoan'), ('race', '04', 'Chinese'), ('race', '18', 'AsianIndian'),
  ('race', '78', 'CombinedAsianPacificIslander'), ('race', '06', 'Hawaiian'), ('race', '48', 'Vietnamese'), ('race', '58', 'Guamanian'),
  ('his', '1', 'Mexican'), ('his', '2', 'PuertoRican'), ('his', '3', 'Cuban'), ('his', '4', 'CentralSouthAmerican'), ('his', '5', 'OtherUnknown'),
  ('his', '6', 'NonHispanicWhite'), ('his', '7', 'NonHispanicBlack'), ('his', '8', 'NonHispanicOther'), ('his', '9', 'HispanicUnknown'))"""


def _decoded(alias: str, col: str, field: str) -> str:
    return f"LEFT JOIN books {alias} ON {alias}.col = '{col}' AND {alias}.k IS NOT DISTINCT FROM d.{field}"


PACKED = "string_agg(icd_code, ',' ORDER BY icd_code)"

ORACLES: dict[str, str] = {
    "scan_project_cast": """
SELECT c_custkey AS subject_id, c_name || ', ' || c_mktsegment AS name, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance,
       CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS segment FROM customer""",
    "tsv_scan": """
SELECT event_id AS drug_seq, CASE WHEN event_type <> 'error' THEN event_type END AS role_cod,
       CAST(length(props) AS BIGINT) AS standard_concept_id, user_id AS subject_id FROM events""",
    "quoted_line_breaks": """
SELECT p_partkey AS part_key, p_brand AS brand, CASE WHEN p_size <= 40 THEN CAST(p_size AS BIGINT) END AS size, CAST(length(note) AS BIGINT) AS n, md5(note) AS digest
FROM (SELECT *, p_name || chr(10) || chr(10) || '"size", ' || p_size || chr(10) || p_type AS note FROM part)""",
    "fixed_width_rejects": f"""WITH {DEATHS}
SELECT 'record' AS kind, data_year AS what, count(*) AS n FROM deaths WHERE o_orderkey % 10 NOT IN (1, 2, 3, 4) GROUP BY data_year
UNION ALL
SELECT 'reject', CASE o_orderkey % 10 WHEN 1 THEN 'too short' WHEN 2 THEN 'too long' WHEN 3 THEN 'no underlying_cause'
                 ELSE 'too short, no data_year, no underlying_cause' END AS what, count(*)
FROM deaths WHERE o_orderkey % 10 IN (1, 2, 3, 4) GROUP BY what""",
    "adverse_files_study": f"""WITH {ADVERSE}, {ADVERSE_VISITS},
pairs AS (
  SELECT subject_id, dense_rank() OVER (ORDER BY drug_seq) AS admit_id, indi_desc, CAST(s_nationkey AS VARCHAR) AS snomed_code
  FROM drug JOIN indication USING (subject_id) LEFT JOIN supplier ON s_suppkey = indi_snomed_id
  WHERE subject_id IN (SELECT subject_id FROM chosen)),
selection AS (SELECT * FROM pairs JOIN nations USING (snomed_code) WHERE regexp_matches(indi_desc, 'AUTO')),
cohort AS (
  SELECT DISTINCT subject_id FROM selection WHERE icd_code = 'R3' AND admit_id > 1
  AND subject_id NOT IN (SELECT subject_id FROM selection WHERE icd_code = 'N7'))
SELECT ccs_desc AS condition, count(DISTINCT subject_id) AS count FROM outcome_visits JOIN nations USING (icd_code)
WHERE subject_id IN (FROM cohort) GROUP BY ccs_desc""",
    "baskets_rewritten": f"""{COHORT}
SELECT 'plus' AS cohort, subject_id || ',' || admit_id || ',' || string_agg(ccs_code, ',' ORDER BY ccs_code) AS line, CAST(NULL AS BIGINT) AS n FROM tidy
WHERE subject_id IN (FROM plus) GROUP BY subject_id, admit_id
UNION ALL
SELECT 'minus', subject_id || ',' || admit_id || ',' || string_agg(ccs_code, ',' ORDER BY ccs_code), NULL FROM tidy
WHERE subject_id IN (FROM minus) GROUP BY subject_id, admit_id
UNION ALL
SELECT 'counted', subject_id || ',' || admit_id || ',' || ccs_code, count(*) FROM tidy WHERE subject_id IN (FROM plus) GROUP BY subject_id, admit_id, ccs_code""",
    "level_choices": f"WITH {HIER} SELECT DISTINCT ccs2 AS label, ccs2_code AS code FROM hier",
    "fixed_width_parse": f"""WITH {DEATHS}
SELECT o_orderkey, res_status, education_89, education_03, sex, age_group, age_infant, marital, data_year, underlying_cause,
       multiple_causes, race, hispanic_recode FROM deaths""",
    "hierarchy_fill": f"WITH {RAW_LEVELS} SELECT * FROM levels",
    "icd9_hierarchy": f"""WITH {RAW_LEVELS}, {BRIDGE},
chapters AS (
  SELECT CAST(p_partkey AS VARCHAR) AS icd, p_type AS icd_chp, CAST(dense_rank() OVER (ORDER BY lead) AS VARCHAR) AS icd_c
  FROM (SELECT *, min(p_partkey) OVER (PARTITION BY p_type) AS lead FROM part)),
single AS (
  SELECT CAST(p_partkey AS VARCHAR) AS code, CAST(n_nationkey AS VARCHAR) AS ccs_code, n_name AS ccs_desc
  FROM part JOIN nation ON p_size = n_nationkey)
SELECT l.icd_code, p_name AS icd_desc, ccs_code, ccs_desc, lvl1_cd AS ccs1_code, lvl1_desc AS ccs1_desc, lvl2_cd AS ccs2_code,
       lvl2_desc AS ccs2_desc, lvl3_cd AS ccs3_code, lvl3_desc AS ccs3_desc, icd_c AS icd_chp_code, icd_chp AS icd_chp_desc,
       snomed_code, snomed_desc, l.icd_code || ' - ' || p_name AS icd, icd_c || ' - ' || icd_chp AS icd_c,
       ccs_code || ' - ' || ccs_desc AS ccs_s, lvl1_cd || ' - ' || lvl1_desc AS ccs1, lvl2_cd || ' - ' || lvl2_desc AS ccs2,
       lvl3_cd || ' - ' || lvl3_desc AS ccs3, coalesce(snomed_code, 'NA') || ' - ' || coalesce(snomed_desc, 'NA') AS snomed
FROM levels l JOIN part ON CAST(p_partkey AS VARCHAR) = l.icd_code JOIN single ON code = l.icd_code JOIN chapters ON icd = l.icd_code
LEFT JOIN bridge b ON b.icd_code = l.icd_code""",
    "chapter_ranges": f"""WITH {ICD10_CODES}
SELECT code AS icd_code, p_name AS icd_desc, icd_chp_code, icd_chp_desc, code || ' - ' || p_name AS icd,
       coalesce(icd_chp_code, 'NA') || ' - ' || coalesce(icd_chp_desc, 'NA') AS icd_c, code || ' - ' || p_brand AS ccs_s,
       code || ' - ' || p_type AS ccs1, code || ' - ' || p_type AS ccs2, mode FROM placed""",
    "chapter_ordinal": """
SELECT CAST(p_partkey AS VARCHAR) AS icd, p_name AS icd_chp, CAST(dense_rank() OVER (ORDER BY lead) AS VARCHAR) AS icd_c
FROM (SELECT *, min(p_partkey) OVER (PARTITION BY p_name) AS lead FROM part)""",
    "bridge_union": f"WITH {BRIDGE} SELECT * FROM bridge",
    "mapping_coverage": f"""WITH {HIER}, {FANNED}
SELECT 'unmapped' AS kind, CAST(l_partkey AS VARCHAR) AS icd_code, count(*) AS n FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM part JOIN nation ON p_size = n_nationkey) GROUP BY l_partkey
UNION ALL SELECT 'several', icd_code, count(*) FROM fanned GROUP BY icd_code HAVING count(*) > 1""",
    "recode_label": """
SELECT icd_code, icd_desc, ccs1_code, ccs1_desc, icd_code || ' - ' || coalesce(icd_desc, 'NA') AS icd,
       coalesce(ccs1_code, 'NA') || ' - ' || coalesce(ccs1_desc, 'NA') AS ccs1
FROM (SELECT CAST(p_partkey AS VARCHAR) AS icd_code, CASE WHEN p_size <> 7 THEN p_name END AS icd_desc,
             CASE WHEN p_type <> 'SMALL' THEN p_type END AS ccs1_code,
             CASE WHEN p_type = 'PROMO' THEN 'Mental Illness' WHEN p_type <> 'LARGE' THEN lower(p_type) END AS ccs1_desc FROM part)""",
    "with_hierarchy": f"""WITH {VISITS}, {HIER}, {FANNED}
SELECT subject_id, admit_id, icd_code, ccs2_code, ccs1_desc, icd_chp_code, snomed_code FROM visits JOIN fanned USING (icd_code)""",
    "hierarchy_browse": f"WITH {HIER} SELECT * FROM hier",
    "visit_number": f"WITH {VISITS} SELECT DISTINCT subject_id, hadm_id, admit_id FROM visits",
    "daily_visits": """
SELECT user_id AS subject_id, dense_rank() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts)) AS admit_id,
       event_type AS icd_code FROM events""",
    "age_at_first_visit": """
SELECT c_custkey AS subject_id,
       round(epoch_us(first) / 1e6 / 604800 / 52.25 - epoch_us(dob) / 1e6 / 604800 / 52.25, 6) AS age,
       round(epoch_us(dod) / 1e6 / 604800 / 52.25 - epoch_us(dob) / 1e6 / 604800 / 52.25, 6) AS age_dod
FROM (SELECT c_custkey, CAST(DATE '1940-01-01' + c_nationkey * 500 AS TIMESTAMP) AS dob,
             CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2001-06-30 12:00:00' END AS dod FROM customer)
JOIN (SELECT o_custkey, min(CAST(o_orderdate AS TIMESTAMP)) AS first FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""",
    "first_row_per_subject": """
SELECT c_custkey AS subject_id,
       round(epoch_us(CAST(o_orderdate AS TIMESTAMP)) / 1e6 / 604800 / 52.25
             - epoch_us(CAST(DATE '1940-01-01' + c_nationkey * 500 AS TIMESTAMP)) / 1e6 / 604800 / 52.25, 6) AS age,
       substr(c_mktsegment, 1, 1) AS gender, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS expire_flag,
       o_orderpriority AS admission_type, o_orderstatus AS admission_location
FROM customer JOIN orders ON o_custkey = c_custkey
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate, o_orderpriority, o_orderstatus) = 1""",
    "pack_visits": f"WITH {VISITS} SELECT subject_id, admit_id, {PACKED} AS items FROM visits GROUP BY subject_id, admit_id",
    "unpack_visits": f"WITH {VISITS} SELECT subject_id, admit_id, icd_code FROM visits",
    "global_dense_rank": "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_totalprice) AS price_rank FROM orders",
    "surrogate_ids": "SELECT count(*) AS n, count(*) AS n_ids, 1 AS low, count(*) AS high FROM lineitem",
    "coalesce_ids": f"WITH {ADVERSE} SELECT * FROM indication",
    "concept_hops": f"""WITH {ADVERSE}, {ADVERSE_VISITS}
SELECT subject_id, admit_id, icd_code, count(*) AS n FROM outcome_visits GROUP BY ALL""",
    "adverse_demographics": f"""WITH {ADVERSE}
SELECT subject_id, drug_seq, drug_id, d.p_name AS drug_desc, indi_desc, indi_snomed_id, CAST(i.p_partkey AS VARCHAR) AS indi_snomed_code,
       i.p_name AS indi_snomed_desc
FROM drug JOIN indication USING (subject_id) LEFT JOIN part d ON d.p_partkey = drug_id LEFT JOIN part i ON i.p_partkey = indi_snomed_id
WHERE subject_id IN (SELECT subject_id FROM chosen)""",
    "text_cohort_vs_code_cohort": f"""WITH {ADVERSE},
found AS (
  SELECT doc_id, regexp_matches(text, '[0-9]{{3}}|licen[cs]e') AS t,
         CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) IN (
           SELECT s_suppkey FROM supplier WHERE CAST(s_nationkey AS VARCHAR) IN (SELECT snomed_code FROM nations WHERE ccs_desc = 'ASIA')) AS c
  FROM documents)
SELECT count(*) FILTER (t) AS by_text, count(*) FILTER (c) AS by_code, count(*) FILTER (t AND c) AS in_both,
       count(*) FILTER (t AND NOT c) AS text_only, count(*) FILTER (c AND NOT t) AS code_only FROM found""",
    "usage_over_threshold": f"""WITH {ADVERSE}
SELECT p_name AS concept_name, count(*) AS count FROM chosen LEFT JOIN drug USING (subject_id) LEFT JOIN part ON p_partkey = drug_id
GROUP BY p_name HAVING count(*) > 50""",
    "condition_group_report": f"""WITH {VISITS}, {HIER}, {FANNED},
firsts AS (
  SELECT subject_id, icd_code FROM visits JOIN hier USING (icd_code) WHERE ccs_code IN ('7', '12')
  QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY admit_id, icd_code) = 1)
SELECT 'rows' AS kind, icd_desc, ccs_desc, count(*) AS n FROM visits JOIN fanned USING (icd_code) WHERE ccs_code IN ('7', '12') GROUP BY ALL
UNION ALL SELECT 'patients', icd_desc, '', count(*) FROM firsts JOIN hier USING (icd_code) GROUP BY icd_desc""",
    "split_axes": f"WITH {DEATHS} SELECT * FROM packed_deaths",
    "decode_dictionaries": f"""WITH {DEATHS}, {BOOKS}
SELECT d.o_orderkey AS subject_id, b1.label AS citizenship, b2.label AS education1, b3.label AS education2, d.sex AS sex_at_birth,
       b4.label AS age_group, b5.label AS age_infant, d.marital, b6.label AS race, b7.label AS hispanic
FROM deaths d {_decoded('b1', 'res', 'res_status')} {_decoded('b2', 'e89', 'education_89')} {_decoded('b3', 'e03', 'education_03')}
{_decoded('b4', 'age', 'age_group')} {_decoded('b5', 'inf', 'age_infant')} {_decoded('b6', 'race', 'race')}
{_decoded('b7', 'his', 'hispanic_recode')}""",
    "mortality_condition_rows": f"""WITH {DEATHS}
SELECT admit_id, icd_code, count(*) AS count FROM (SELECT admit_id, unnest(string_split(icd_code, ',')) AS icd_code FROM packed_deaths) GROUP BY ALL""",
    "base_cohort": f"{COHORT} SELECT subject_id FROM base",
    "cohort_plus": f"{COHORT} SELECT subject_id FROM plus",
    "cohort_minus": f"{COHORT} SELECT subject_id FROM minus",
    "cohort_all_visits": f"""{COHORT}
SELECT DISTINCT subject_id FROM tidy WHERE ccs2_code = 'PROMO.13'
AND subject_id NOT IN (SELECT subject_id FROM tidy WHERE ccs2_code = 'LARGE.7')""",
    "unique_codes": f"{COHORT} SELECT DISTINCT subject_id, icd_code FROM tidy WHERE subject_id IN (FROM plus)",
    "cohort_demographics": f"{COHORT} SELECT * FROM people WHERE subject_id IN (FROM minus)",
    "association_baskets": f"""{COHORT}
SELECT subject_id || ',' || string_agg(ccs_desc, ',' ORDER BY ccs_desc) AS line FROM tidy
WHERE subject_id IN (FROM plus) GROUP BY subject_id, admit_id""",
    "sequence_baskets": f"""{COHORT}
SELECT subject_id || ',' || admit_id || ',' || string_agg(ccs_code, ',' ORDER BY ccs_code) AS line FROM tidy
WHERE subject_id IN (FROM minus) GROUP BY subject_id, admit_id""",
    "condition_rows_top20": f"""WITH {VISITS}, {HIER}, {FANNED}
SELECT ccs2_desc AS condition, count(*) AS count FROM visits JOIN fanned USING (icd_code) GROUP BY ccs2_desc
QUALIFY rank() OVER (ORDER BY count(*) DESC) <= 20""",
    "condition_patients_top20": f"""{COHORT}
SELECT ccs_desc AS condition, count(DISTINCT subject_id) AS count FROM tidy WHERE subject_id IN (FROM plus) GROUP BY ccs_desc
QUALIFY rank() OVER (ORDER BY count(DISTINCT subject_id) DESC) <= 20""",
    "hospital_files_study": f"""{COHORT}
SELECT ccs_desc AS condition, count(DISTINCT subject_id) AS count FROM tidy WHERE subject_id IN (FROM plus) GROUP BY ccs_desc
QUALIFY rank() OVER (ORDER BY count(DISTINCT subject_id) DESC) <= 20""",
    "mortality_files_study": f"""WITH {DEATHS}
SELECT n_name AS condition, count(*) AS count FROM (SELECT unnest(string_split(icd_code, ',')) AS code FROM packed_deaths)
JOIN nation ON code = 'C' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') GROUP BY n_name QUALIFY rank() OVER (ORDER BY count(*) DESC) <= 5""",
    "demographic_counts": f"{COHORT} SELECT region, segment, count(*) AS count FROM people WHERE subject_id IN (FROM plus) GROUP BY ALL",
    "demographic_values": f"{COHORT} SELECT nation AS value, count(*) AS count FROM people WHERE subject_id IN (FROM minus) GROUP BY ALL",
    "adverse_cohort_baskets": f"""{ADVERSE_STUDY}
SELECT subject_id, admit_id, item, count(*) AS n FROM coded WHERE subject_id IN (FROM cohort) GROUP BY ALL""",
    "adverse_condition_rows": f"""{ADVERSE_STUDY}
SELECT condition, count(*) AS count FROM coded GROUP BY condition QUALIFY rank() OVER (ORDER BY count(*) DESC) <= 3""",
    "adverse_condition_patients": f"""{ADVERSE_STUDY}
SELECT condition, count(DISTINCT subject_id) AS count FROM coded WHERE subject_id IN (FROM cohort) GROUP BY condition""",
    "adverse_sequences": f"""{ADVERSE_STUDY},
{_mined("SELECT DISTINCT subject_id, admit_id AS visit, item AS state FROM coded", 0.9, 5)}
SELECT sequence, round(support, 9) AS support FROM mined""",
    "frequent_sequences": f"""{COHORT}, {_mined("SELECT DISTINCT subject_id, admit_id AS visit, ccs_code AS state FROM tidy WHERE subject_id IN (FROM plus)", 0.25, 5)}
SELECT sequence, length AS n_states, round(support, 9) AS support FROM mined""",
    "frequent_event_sequences": f"""WITH {_mined("SELECT DISTINCT user_id AS subject_id, dense_rank() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts)) AS visit, event_type || ' ' || CAST(floor(value / 25) AS INT) AS state FROM events", 0.9, 5)}
SELECT sequence, round(support, 9) AS support FROM mined""",
    "frequent_itemset_sequences": f"""WITH {VISITS}, {HIER}, singles AS ({TYPES}), {_mined("FROM sets", 0.8, 5).replace("occ AS (FROM sets)", """sets AS (
  SELECT subject_id, visit, state FROM singles
  UNION ALL SELECT a.subject_id, a.visit, a.state || ' | ' || b.state FROM singles a JOIN singles b USING (subject_id, visit) WHERE a.state < b.state
  UNION ALL SELECT a.subject_id, a.visit, a.state || ' | ' || b.state || ' | ' || c.state
    FROM singles a JOIN singles b USING (subject_id, visit) JOIN singles c USING (subject_id, visit) WHERE a.state < b.state AND b.state < c.state
  UNION ALL SELECT a.subject_id, a.visit, a.state || ' | ' || b.state || ' | ' || c.state || ' | ' || d.state
    FROM singles a JOIN singles b USING (subject_id, visit) JOIN singles c USING (subject_id, visit) JOIN singles d USING (subject_id, visit)
    WHERE a.state < b.state AND b.state < c.state AND c.state < d.state),
occ AS (FROM sets)""")}
SELECT sequence, round(support, 9) AS support FROM mined""",
    "sequence_states": f"""{MINED_TYPES}
SELECT sequence, round(support, 9) AS support, p[1] AS c_1, p[2] AS c_2, p[3] AS c_3, p[4] AS c_4, p[5] AS c_5,
       p[6] AS c_6, p[7] AS c_7, p[8] AS c_8, length FROM mined""",
    "sequence_flags": f"{MINED_BRANDS}, {_flag_tables()} {FLAGS}",
    "sequence_flags_four_states": f"{MINED_TYPES}, {_flag_tables()} {FLAGS}",
    "event_path_flags": f"WITH {_paths()}, {_flag_tables()} {FLAGS}",
    "event_weekday_flags": f"WITH {_paths('isodow(ts)')}, {_flag_tables()} {FLAGS}",
    "event_path_described": f"""WITH {_paths()}
SELECT sequence, len(p) AS length, array_to_string(list_transform(p, lambda x: x || ' events'), ' / ') AS described FROM mined
WHERE NOT list_contains(p, '9') AND p[1] IN ('1', '2', '3') AND list_contains(p, '4')""",
    "sequence_no_repeats": f"""{MINED_TYPES}
SELECT sequence, 'documented' AS mode FROM mined WHERE length >= 2 AND len(list_distinct(p)) = length
UNION ALL SELECT sequence, 'padded' FROM mined WHERE length >= (SELECT max(length) FROM mined) - 1 AND len(list_distinct(p)) = length""",
    "sequence_described": f"{DESCRIBED} SELECT sequence, round(support, 9) AS support, array_to_string(states, ' / ') AS described FROM described",
    "sequence_search": f"""{DESCRIBED}
SELECT sequence, array_to_string(states, ' / ') AS described FROM described
WHERE NOT regexp_matches(array_to_string(states, ' / '), '[Uu]nclassified') AND regexp_matches(states[1], 'promo|all')
AND regexp_matches(array_to_string(states, ' / '), 'large|standard')""",
    "sequence_links": f"""{DESCRIBED},
steps AS (SELECT support, j, states[j] || ' (' || j || ')' AS a, states[j + 1] || ' (' || (j + 1) || ')' AS b
          FROM described, range(1, 20) r(j) WHERE j < len(states))
SELECT a AS "from", b AS "to", round(max(support), 9) AS max_support FROM steps GROUP BY a, b""",
    "sequence_study": f"""{COHORT}, {_mined("SELECT DISTINCT subject_id, admit_id AS visit, ccs_code AS state FROM tidy WHERE subject_id IN (FROM minus)", 0.25, 5)},
{_flag_tables()}
SELECT m.sequence, round(support, 9) AS support, array_to_string(list_transform(p, lambda x: 'Brand#' || x), ' / ') AS described, length,
       consec, non_consec, embed_consec, embed_non_consec
FROM mined m JOIN flags f ON f.sequence = m.sequence AND f.mode = 'documented'
WHERE length >= 2 AND len(list_distinct(p)) = length AND len(list_filter(p, lambda x: contains('Brand#' || x, 'Brand#1'))) > 0""",
    "item_frequency": f"""{COHORT},
txn AS (SELECT DISTINCT subject_id, admit_id, ccs_desc AS item FROM tidy WHERE subject_id IN (FROM plus)),
total AS (SELECT count(DISTINCT (subject_id, admit_id)) AS n FROM txn)
SELECT item, count(*) AS count, round(count(*) / n, 9) AS frequency FROM txn, total GROUP BY item, n HAVING round(count(*) / n, 9) >= 0.05
ORDER BY count(*) DESC, item LIMIT 10""",
    "association_rules": f"{TYPE_RULES} SELECT * FROM flat",
    "cohort_rules": f"""WITH RECURSIVE {COHORT.removeprefix('WITH ')},
{_rules("SELECT DISTINCT subject_id, admit_id, ccs_desc AS item FROM tidy WHERE subject_id IN (FROM plus)", 0.005, 0.17)}
SELECT * FROM flat""",
    "top_rules": f"{TYPE_RULES} SELECT * FROM flat ORDER BY lift DESC, antecedent, consequent LIMIT 10",
    "rule_sides": f"""{TYPE_RULES}
SELECT consequent, count(*) AS n_antecedents, round(avg(lift), 9) AS lift, round(avg(confidence), 9) AS confidence, round(avg(support), 9) AS support
FROM flat GROUP BY consequent""",
    "bounded_rules": BOUNDED_RULES,
    "rule_clusters": f"""{TYPE_RULES}, {_clustered(5, 10)}
SELECT k AS cluster, consequent, count(*) AS n_antecedents, round(avg(raw_support), 9) AS support, round(avg(raw_confidence), 9) AS confidence,
       round(avg(raw_lift), 9) AS lift
FROM rules JOIN a10 ON lhs = antecedent GROUP BY k, consequent""",
    "rule_lift_table": f"""{TYPE_RULES}
SELECT a.antecedent, c.consequent, coalesce(f.lift, 1.0) AS lift
FROM (SELECT DISTINCT antecedent FROM flat) a CROSS JOIN (SELECT DISTINCT consequent FROM flat) c
LEFT JOIN flat f ON f.antecedent = a.antecedent AND f.consequent = c.consequent""",
    "admissions_by_header": """SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS admission_type,
       o_orderstatus AS insurance, CAST(NULL AS VARCHAR) AS language, 'x' AS religion, day(o_orderdate) AS flag FROM orders""",
    "tsv_with_header": """SELECT p_partkey AS concept_id, p_name AS concept_name, CASE WHEN p_size > 25 THEN p_type END AS domain_id,
       p_brand AS concept_code, CAST(NULL AS VARCHAR) AS vocabulary_id FROM part""",
    "all_text_csv": """SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS icd_code, p_type AS lvl1_cd, p_name AS lvl1_desc,
       lpad(CAST(p_size AS VARCHAR), 4, '0') AS lvl2_cd, p_brand AS lvl2_desc, CAST(NULL AS VARCHAR) AS lvl3_cd FROM part""",
    "rule_graph": f"""{TYPE_RULES},
best AS (SELECT *, '{{' || antecedent || '}} => {{' || consequent || '}}' AS rule FROM flat ORDER BY confidence DESC, antecedent, consequent LIMIT 10),
lhs AS (SELECT unnest(string_split(antecedent, ',')) AS item, rule FROM best)
SELECT 'item' AS kind, item AS source, '' AS target, CAST(NULL AS DOUBLE) AS lift FROM (SELECT item FROM lhs UNION SELECT consequent FROM best)
UNION ALL SELECT 'rule', rule, '', lift FROM best
UNION ALL SELECT 'edge', item, rule, NULL FROM lhs
UNION ALL SELECT 'edge', rule, consequent, NULL FROM best""",
    "basket_roundtrip": f"""{COHORT}
SELECT DISTINCT subject_id, CAST(admit_id AS BIGINT) AS admit_id, ccs_code AS item FROM tidy WHERE subject_id IN (FROM plus)""",
    "transaction_roundtrip": f"""{COHORT}
SELECT CAST(subject_id AS VARCHAR) AS txn_id, string_agg(DISTINCT ccs_desc, ',' ORDER BY ccs_desc) AS items FROM tidy
WHERE subject_id IN (FROM minus) GROUP BY subject_id, admit_id""",
    "delimited_roundtrip": f"""{COHORT}
SELECT subject_id, CAST(admit_id AS BIGINT) AS admit_id, {PACKED} AS icd_code, segment, nation, region
FROM visits JOIN people USING (subject_id) GROUP BY ALL""",
    "parquet_roundtrip": f"WITH {DEATHS} SELECT o_orderkey, data_year, underlying_cause, multiple_causes FROM deaths",
}

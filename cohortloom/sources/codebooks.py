"""Fixed lookup tables: ICD-10 chapters and the code books of the mortality source."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Chapter(NamedTuple):
    number: int
    low: str  # bounds on the three-character category
    high: str
    raw_low: str  # bounds as first published, compared with whole codes
    raw_high: str
    desc: str


# fixed values: ICD-10 chapters
ICD10_CHAPTERS = [
    Chapter(1, "A00", "B99", "", "B99", "certain infectious and parasitic diseases"),
    Chapter(2, "C00", "D48", "C00", "D48", "neoplasms"),
    Chapter(3, "D50", "D89", "D50", "D89", "diseases of the blood and blood-forming organs and certain disorders involving the immune mechanism"),
    Chapter(4, "E00", "E90", "E00", "D90", "endocrine, nutritional and metabolic diseases"),
    Chapter(5, "F00", "F99", "F00", "F99", "mental and behavioral disorders"),
    Chapter(6, "G00", "G99", "G00", "G99", "Diseases of the nervous system"),
    Chapter(7, "H00", "H59", "H00", "H59", "diseases of the eye and adnexa"),
    Chapter(8, "H60", "H95", "H60", "H95", "diseases of the ear and mastoid process"),
    Chapter(9, "I00", "I99", "I00", "I99", "diseases of the circulatory system"),
    Chapter(10, "J00", "J99", "J00", "J99", "diseases of the respiratory system"),
    Chapter(11, "K00", "K93", "K00", "K93", "diseases of the digestive system"),
    Chapter(12, "L00", "L99", "L00", "L99", "diseases of the skin and subcutaneous tissue"),
    Chapter(13, "M00", "M99", "M00", "M99", "diseases of the musculoskeletal system and connective tissue"),
    Chapter(14, "N00", "N99", "N00", "N99", "diseases of the genitourinary system"),
    Chapter(15, "O00", "O99", "O00", "O99", "pregnancy, childbirth and the puerperium"),
    Chapter(16, "P00", "P96", "P00", "P96", "certain conditions originating in the perinatal period"),
    Chapter(17, "Q00", "Q99", "Q00", "Q99", "congenital malformations, deformations and chromosomal abnormalities"),
    Chapter(18, "R00", "R99", "R00", "R99", "symptoms, signs and abnormal clinical and laboratory findings, not elsewhere classified"),
    Chapter(19, "S00", "T98", "S00", "T98", "injury, poisoning and certain other consequences of external causes"),
    Chapter(20, "V01", "Y98", "V01", "Y98", "external causes of morbidity and mortality"),
    Chapter(21, "Z00", "Z99", "Z00", "Z99", "factors influencing health status and contact with health services"),
    Chapter(22, "U00", "U99", "U00", "U99", "codes for special purposes"),
]

# fixed values: code → label for each coded column of the mortality source
MORTALITY_CODEBOOKS = {
    "res_status": {
        "1": "resident", "2": "nonresident_intrastate", "3": "nonresident_interterritory", "4": "foreign_resident",
    },
    "education_89": {
        "00": "no_education", "01": "1", "02": "2", "03": "3", "04": "4", "05": "5", "06": "6", "07": "7", "08": "8",
        "09": "9", "10": "10", "11": "11", "12": "12", "13": "college1", "14": "college2", "15": "college3",
        "16": "college4", "17": "college5+", "99": "not_stated",
    },
    "education_03": {
        "1": "k8", "2": "9-12", "3": "highschool_ged", "4": "some_college", "5": "associate", "6": "bachelors",
        "7": "masters", "8": "phd", "9": "unknown",
    },
    "age_group": {
        "01": "infant", "02": "1-4", "03": "5-14", "04": "15-24", "05": "25-34", "06": "35-44", "07": "45-54",
        "08": "55-64", "09": "65-74", "10": "75-84", "11": "85+", "12": "NotStated",
    },
    "age_infant": {
        None: "NotInfantNotStated", "09": "days7-13", "18": "months7", "11": "days21-27", "13": "months2",
        "16": "months5", "14": "months4", "02": "hours1-23", "15": "months4", "07": "days5", "03": "days1",
        "22": "months11", "12": "months1", "01": "under1hour", "04": "days2", "10": "days14-20", "06": "days4",
        "17": "months6", "08": "days6", "05": "days3", "19": "months8", "21": "months10", "20": "months9",
    },
    "race": {
        "01": "White", "03": "AmericanIndian", "07": "Filipino", "05": "Japanese", "02": "Black", "28": "Korean",
        "68": "OtherAsianPacificIslander", "38": "Samoan", "04": "Chinese", "18": "AsianIndian",
        "78": "CombinedAsianPacificIslander", "06": "Hawaiian", "48": "Vietnamese", "58": "Guamanian",
    },
    "hispanic_recode": {
        "1": "Mexican", "2": "PuertoRican", "3": "Cuban", "4": "CentralSouthAmerican", "5": "OtherUnknown",
        "6": "NonHispanicWhite", "7": "NonHispanicBlack", "8": "NonHispanicOther", "9": "HispanicUnknown",
    },
}


def chapter_table(spark: SparkSession) -> DataFrame:
    rows = [(str(c.number), c.desc) for c in ICD10_CHAPTERS]
    return spark.createDataFrame(rows, "icd_chp_code string, icd_chp_desc string")


def codebook(spark: SparkSession, column: str) -> DataFrame:
    rows = list(MORTALITY_CODEBOOKS[column].items())
    return spark.createDataFrame(rows, f"{column}_key string, {column}_label string")

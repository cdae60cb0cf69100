"""JSON payloads: one document with metadata and one array of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

LESSON = (
    "struct<day:string,dayIndex:int,periodStart:int,periodEnd:int,subject:string,classCode:string,grade:int,section:int>"
)
OWNER = (
    "id string, fullName string, searchName string, softSearchName string, compactSearchName string, sourcePage int, "
    f"grades array<int>, subjects array<string>, lessonCount int, occupiedPeriodCount int, lessons array<{LESSON}>"
)
ROSTER = (
    "id string, fullName string, searchName string, softSearchName string, compactSearchName string, grade int, "
    "section int, rosterOrder int, enrollmentNumber string, sourceSheet string, sourceRow int, academicYear string"
)
CLASS_LESSON = (
    "struct<day:string,dayIndex:int,periodStart:int,periodEnd:int,subject:string,teacherLabel:string,"
    "teacherId:string,teacherFullName:string>"
)
CLASS = f"classCode string, grade int, section int, sourcePage int, lessons array<{CLASS_LESSON}>"
ACTIVITY = (
    "id string, sourceId string, date string, title string, description string, category string, "
    "audiences array<string>, people array<string>, grades array<int>, specialist boolean, "
    "media array<struct<type:string,url:string,localPath:string,alt:string>>, sourceUrl string, sourceLabel string, "
    "verifiedAt string"
)


def read_payload(
    spark: SparkSession, path: str, records: str, record: str, meta: str = "", lines: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(metadata, records) of JSON documents of the form {metadata..., records: [...]}.

    ``record`` and ``meta`` are schema texts; nothing is inferred. Each document is one row of metadata.
    A file is one document, or with ``lines`` one document per line, which can be split over tasks.
    """
    inner = StructType.fromDDL(record)
    outer = StructType.fromDDL(meta) if meta else StructType([])
    schema = StructType([*outer.fields, StructField(records, ArrayType(inner))])
    documents = spark.read.schema(schema).json(path, multiLine=not lines)
    return documents.select(*[f.name for f in outer.fields]), documents.select(F.inline(records))


def read_records(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Records of a document that is one array."""
    return spark.read.schema(record).json(path, multiLine=True)


def flatten_lessons(owners: DataFrame, *keep: str) -> DataFrame:
    """One row per lesson of each owner."""
    return owners.select(*keep, F.inline("lessons"))

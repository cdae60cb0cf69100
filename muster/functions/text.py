"""Script-aware text functions, all returning Columns.

Everything but NFKC runs inside the JVM. NFKC has no Spark built-in, so one Arrow-batched
function does it, and text that NFKC cannot change is passed to it as null.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Character classes and fold tables that decide what counts as equal.
MARK_LETTERS = "".join(map(chr, (*range(0x064B, 0x0660), 0x0670, *range(0x06D6, 0x06EE))))
MARKS_NARROW = r"[\u064B-\u065F\u0670]"
WHITESPACE = r"[\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
TATWEEL = "ـ"
FOLDABLE = r"[\u0600-\u06FF\t-\r\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
BLANKS = "\t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
ALEF_FORMS, ALEF = "أإآٱ", "ا"
MAQSURA, YA = "ى", "ي"
SOFT_FROM, SOFT_TO = "ةؤئ", "هوي"
TA_MARBUTA, HA = "ة", "ه"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
ASCII_DIGITS = "01234567890123456789"

# Grade words as printed in sheet names and lesson labels (some are cut off in print).
SHEET_GRADES = {"خامس": 5, "سادس": 6, "سابع": 7, "ثامن": 8}
LABEL_GRADES = {"الخامس": 5, "الخام": 5, "السادس": 6, "الساد": 6, "السابع": 7, "الثامن": 8}
GRADE_NAMES = {5: "الخامس", 6: "السادس", 7: "السابع", 8: "الثامن"}
HEADER_CLASS = r"([5-8])\s*[\\/]\s*([0-9]{1,2})"

# Characters NFKC leaves alone when nothing else is in the text. Marks up to U+0652 are included:
# they neither compose with a letter nor survive the mark removal.
_NFKC_INERT = r"^[\x00-\x7F\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF\u0621-\u063A\u0640-\u0652\u0660-\u0669]*$"


@F.pandas_udf(StringType())
def _nfkc_batch(values: pd.Series) -> pd.Series:
    return values.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def needs_nfkc(text: Column) -> Column:
    """True where NFKC might change the text."""
    return ~text.rlike(_NFKC_INERT)


def nfkc(text: Column) -> Column:
    """Unicode NFKC; null stays null."""
    return F.coalesce(_nfkc_batch(F.when(needs_nfkc(text), text)), text)


def _single_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, " {2,}", " "))


def collapse_spaces(text: Column) -> Column:
    """Runs of any whitespace as one blank, none at the ends."""
    return _single_blanks(F.translate(text, BLANKS, " " * len(BLANKS)))


def normalize(text: Column, soft: bool = False, compact: bool = False, canonical: bool = False) -> Column:
    """Search key of a text. ``canonical`` says that the text is in NFKC form already."""
    base = F.coalesce(text, F.lit(""))
    base = base if canonical else nfkc(base)
    source, target = ALEF_FORMS + MAQSURA, ALEF * len(ALEF_FORMS) + YA
    if soft:
        source, target = source + SOFT_FROM, target + SOFT_TO
    # one pass folds letters and blanks and deletes the letters past the end of the target; text that
    # has none of them is left alone
    folded = F.translate(base, source + BLANKS + TATWEEL + MARK_LETTERS, target + " " * len(BLANKS))
    key = _single_blanks(F.when(base.rlike(FOLDABLE), folded).otherwise(base))
    return F.replace(key, F.lit(" "), F.lit("")) if compact else key


def join_key(text: Column, canonical: bool = False) -> Column:
    """Key under which two sources spell the same subject or name."""
    base = F.coalesce(text, F.lit(""))
    base = F.regexp_replace(base if canonical else nfkc(base), MARKS_NARROW, "")
    folded = F.translate(
        base, ALEF_FORMS + MAQSURA + TA_MARBUTA + TATWEEL, ALEF * len(ALEF_FORMS) + YA + HA
    )
    return F.regexp_replace(folded, WHITESPACE + "+", "")


def label_key(text: Column) -> Column:
    """Key of a printed label: alef forms folded, the rest kept."""
    return F.translate(collapse_edges(nfkc(text)), ALEF_FORMS, ALEF * len(ALEF_FORMS))


def collapse_edges(text: Column) -> Column:
    """Strip Unicode whitespace at both ends only."""
    return F.regexp_replace(text, f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def fold_digits(text: Column) -> Column:
    return F.translate(text, ARABIC_DIGITS, ASCII_DIGITS)


def reverse_word(text: Column) -> Column:
    """Logical form of a word stored in visual order."""
    return nfkc(F.reverse(text))


def has_letter(text: Column) -> Column:
    return nfkc(text).rlike(r"\p{L}")


def has_space_run(text: Column) -> Column:
    return text.rlike(WHITESPACE + "{2,}")


def class_from_header(header: Column, sheet: Column) -> Column:
    """Struct (grade, section), from a printed ``g / s`` header or else a sheet name; null when neither parses."""
    name = F.regexp_replace(sheet, WHITESPACE + "+", "")
    printed = F.when(
        header.rlike(HEADER_CLASS),
        F.struct(
            F.regexp_extract(header, HEADER_CLASS, 1).cast("int").alias("grade"),
            F.regexp_extract(header, HEADER_CLASS, 2).cast("int").alias("section"),
        ),
    )
    named = [
        F.when(
            name.rlike(word + "[0-9]{1,2}"),
            F.struct(
                F.lit(grade).alias("grade"),
                F.regexp_extract(name, word + "([0-9]{1,2})", 1).cast("int").alias("section"),
            ),
        )
        for word, grade in SHEET_GRADES.items()
    ]
    return F.coalesce(printed, *named)


def class_from_label(label: Column) -> Column:
    """Struct (grade, section) of a lesson label; null unless one grade word and exactly one number are there."""
    numbers = F.regexp_extract_all(fold_digits(label), F.lit(r"(\d+)"), F.lit(1))
    grade = F.coalesce(*[F.when(F.contains(label, F.lit(w)), F.lit(g)) for w, g in LABEL_GRADES.items()])
    return F.when(
        grade.isNotNull() & (F.size(numbers) == 1),
        F.struct(grade.alias("grade"), F.get(numbers, F.lit(0)).cast("int").alias("section")),
    )


def class_code(grade: Column, section: Column) -> Column:
    return F.concat_ws("/", grade, section)


def record_id(year: Column, grade: Column, section: Column, order: Column) -> Column:
    return F.concat_ws("-", year, grade, section, order)


def page_id(prefix: str, page: Column) -> Column:
    """Page id padded to three digits; longer numbers are kept whole."""
    digits = page.cast("string")
    return F.concat(F.lit(prefix + "-"), F.lpad(digits, F.greatest(F.length(digits), F.lit(3)), F.lit("0")))


def occupied(start: Column, end: Column) -> Column:
    return end - start + 1


def is_placeholder(name: Column, min_tokens: int = 1) -> Column:
    """True when each token is one letter and there are at least ``min_tokens`` of them."""
    tokens = F.filter(F.split(name, WHITESPACE + "+"), lambda t: t != "")
    return (F.size(tokens) >= min_tokens) & F.forall(tokens, lambda t: F.length(t) == 1)


def printed_date(text: Column) -> Column:
    """Date printed as dd/mm/yyyy in any digits; null when it is not one."""
    plain = fold_digits(text)
    return F.when(
        plain.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.to_date(F.try_to_timestamp(plain, F.lit("dd/MM/yyyy")))
    )


def canonical_json(*fields: str) -> Column:
    """JSON with sorted keys, no blanks and nulls kept."""
    return F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"})


def trimmed(value: Column) -> Column:
    """Text without white space of any kind around it, also tabs, line ends and blanks that do not break."""
    return F.regexp_replace(value, r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", "")

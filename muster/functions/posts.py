"""Functions on posts: instants, keyword rules, titles and media addresses."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from muster.functions.text import GRADE_NAMES

# How a time-ordered id carries its millisecond, and the zone that dates posts.
ID_EPOCH_MS = 1_288_834_974_657
ID_SEQUENCE_BITS = 22
LOCAL_ZONE = "Asia/Muscat"

# Category keywords; the first rule with a hit decides.
CATEGORY_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("guidance", ("الإرشاد", "الارشاد", "نفسي", "اجتماعي", "سلوكي", "لائحة شؤون الطلبة")),
    ("transport", ("حافل", "النقل المدرسي", "سائق")),
    ("health", ("صحي", "صحية", "ممرض", "مرض", "سلامة", "المقصف")),
    ("honors", ("تكريم", "كرّم", "كرم", "تهنئة", "احتفاء")),
    ("visits", ("زيارة", "زار", "استقبل", "تفضل")),
    ("community", ("ولي الأمر", "أولياء الأمور", "الشراكة المجتمعية", "المجتمع المحلي")),
    ("media", ("ملخص", "فيديو", "تغطية", "تصميم", "جانب من")),
    ("administration", ("اجتماع", "لجنة", "إدارة المدرسة", "مدير المدرسة", "تنظيم")),
    ("teaching", ("درسًا", "درسا", "حصة", "حصص", "تعلم", "رياضيات", "علوم", "لغة")),
)
DEFAULT_CATEGORY = "student-life"
FLAGGED_CATEGORY = "guidance"

# Audience keywords, in the order the labels are listed.
AUDIENCE_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("الطلبة", ("طالب", "الطلبة", "طلاب")),
    ("المعلمون", ("معلم", "المعلمين", "الهيئة التدريسية")),
    ("أولياء الأمور", ("ولي الأمر", "أولياء الأمور")),
)
FLAGGED_AUDIENCE, DEFAULT_AUDIENCE = "الأخصائيون", "المجتمع المدرسي"

# Grade mentions, title form and media addresses.
GRADE_MENTION = "(?:الصف|صف)\\s*(الخامس|السادس|السابع|الثامن|[٥-٨5-8])"
MENTIONED_GRADES = {name: grade for grade, name in GRADE_NAMES.items()} | {
    "٥": 5, "٦": 6, "٧": 7, "٨": 8, "5": 5, "6": 6, "7": 7, "8": 8,
}
LINKS_AND_TAGS = r"https?://(?U:\S)+|#(?U:[\w\u0600-\u06FF])+"
TITLE_EDGES, TITLE_END = " .،ـ-", "[!؟\\n]"
TITLE_LIMIT, TITLE_CUT, TITLE_DEFAULT = 92, 89, "فعالية مدرسية"
VIDEO_LABEL = "فيديو: "
IMAGE_SUFFIX = r"\.(jpg|jpeg|png|webp)$"
MEDIA_HOST = "pbs.twimg.com"
STEM_LENGTH = 24

Rules = Sequence[tuple[str, Sequence[str]]]


def id_millis(source_id: Column) -> Column:
    return F.shiftright(source_id.cast("bigint"), ID_SEQUENCE_BITS) + ID_EPOCH_MS


def post_instant(stamp: Column, source_id: Column) -> Column:
    """Instant of a post: its ISO stamp (UTC when it names no zone) or else the one inside its id.

    Naive stamps are read in the session zone, which the library keeps at UTC.
    """
    return F.coalesce(F.try_to_timestamp(stamp), F.timestamp_millis(id_millis(source_id)))


def local_date(instant: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(instant, zone))


def mentions(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def category(text: Column, rules: Rules = CATEGORY_RULES, default: str = DEFAULT_CATEGORY) -> Column:
    hits = [F.when(mentions(text, words), F.lit(name)) for name, words in rules]
    return F.coalesce(*hits, F.lit(default))


def is_flagged(category_col: Column) -> Column:
    return category_col == FLAGGED_CATEGORY


def audiences(
    text: Column,
    flagged: Column,
    rules: Rules = AUDIENCE_RULES,
    flagged_label: str = FLAGGED_AUDIENCE,
    default: str = DEFAULT_AUDIENCE,
) -> Column:
    labels = F.array(
        *[F.when(mentions(text, words), F.lit(name)) for name, words in rules],
        F.when(flagged, F.lit(flagged_label)),
    )
    found = F.array_distinct(F.array_compact(labels))
    return F.when(F.size(found) == 0, F.array(F.lit(default))).otherwise(found)


def grade_mentions(text: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in MENTIONED_GRADES.items() for x in pair])
    found = F.regexp_extract_all(text, F.lit(GRADE_MENTION), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda w: F.element_at(lookup, w))))


def title(text: Column, default: str = TITLE_DEFAULT) -> Column:
    # A title never goes past the first line break, links hold none, and the break also ends the
    # trimming at the far end, so the first line decides it.
    line = F.substring_index(text, "\n", 1)
    bare = F.regexp_replace(F.regexp_replace(line, LINKS_AND_TAGS, ""), f"^[{TITLE_EDGES}]+", "")
    bare = F.when(F.contains(text, F.lit("\n")), bare).otherwise(F.regexp_replace(bare, f"[{TITLE_EDGES}]+$", ""))
    sentence = F.get(F.split(bare, TITLE_END, 2), F.lit(0))
    sentence = F.regexp_replace(sentence, r"(?U)^\s+|\s+$", "")
    cut = F.concat(F.regexp_replace(F.substring(sentence, 1, TITLE_CUT), r"(?s) [^ ]*$", ""), F.lit("…"))
    return (
        F.when(sentence == "", F.lit(default)).when(F.length(sentence) <= TITLE_LIMIT, sentence).otherwise(cut)
    )


def media_key(url: Column) -> Column:
    """Identity of a media address: its path without an image suffix."""
    return F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), IMAGE_SUFFIX, "")


def media_stem(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, STEM_LENGTH)


def is_allowed(url: Column, host: str = MEDIA_HOST) -> Column:
    """Only https and exactly this host, with no port or user part."""
    return F.coalesce(
        (F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & (F.try_parse_url(url, F.lit("AUTHORITY")) == host),
        F.lit(False),
    )


def media_items(images: Column, posters: Column, alt: Column) -> Column:
    """Media structs of a post: images first, then posters that are not images already."""
    image = F.transform(
        images,
        lambda u: F.struct(
            F.lit("image").alias("type"), u.alias("url"), F.lit(None).cast("string").alias("localPath"), alt.alias("alt")
        ),
    )
    poster = F.transform(
        F.array_except(posters, images),
        lambda u: F.struct(
            F.lit("video").alias("type"),
            u.alias("url"),
            F.lit(None).cast("string").alias("localPath"),
            F.concat(F.lit(VIDEO_LABEL), alt).alias("alt"),
        ),
    )
    return F.concat(image, poster)

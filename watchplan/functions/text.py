"""String, array and JSON functions of the catalogue, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that don't count as keywords of a rule.
STOPWORDS = [
    "a", "an", "the", "if", "is", "are", "was", "were", "be", "being", "been",
    "person", "people", "someone", "subject", "there", "visible", "video", "frame",
    "scene", "alert", "notify", "tell", "me", "when", "with", "and", "or", "to",
    "in", "on", "near", "at", "from", "of", "for", "any", "all", "rule",
]
#: Patterns of questions that ask for a change, and of words that speak of a past one.
WRITE_PATTERNS = [
    r"\b(delete|drop|truncate|wipe)\b\s+\w",
    r"\b(update|alter|modify)\b\s+\w",
    r"\b(clear|remove)\s+(all|the|every)\b",
    r"\b(remove|drop)\s+(table|tables|database|db|records?|data|logs?)\b",
    r"\b(remove|drop)\s+(the\s+)?(anomaly|entry|employee|visitor|camera|rule|schedule)\b",
    r"\b(clear|wipe)\s+(the\s+)?(database|table|log|records?|data|entries|everything)\b",
    r"\binsert\s+into\b",
    r"\badd\s+(a\s+)?(new\s+)?(record|row|entry|employee|visitor|camera)\b",
    r"\bcreate\s+(a\s+)?table\b",
    r"\b(grant|revoke)\b\s+\w",
    r"\b(reset|set)\s+\w+\s+(to|=)\b",
]
PAST_PATTERN = r"\b(inserted|added|created|logged)\b"
#: Words that name something to be seen.
VISUAL_WORDS = [
    "person", "people", "subject", "body", "torso", "head", "arm", "arms", "hand", "hands",
    "leg", "legs", "knee", "knees", "foot", "feet", "limb", "posture", "floor", "ground",
    "lying", "prone", "sitting", "standing", "walking", "running", "sprinting", "stumbling",
    "fall", "falling", "collapsed", "collapse", "contact", "touching", "holding", "grabbing",
    "pushing", "shoving", "pulling", "hitting", "kicking", "grappling", "wrestling",
    "door", "window", "gate", "cabinet", "equipment", "machine", "panel", "object", "chair",
    "knife", "gun", "weapon", "fire", "smoke", "flame", "blocked", "covered", "camera",
]
#: Words of scores, and words of concrete things that make a sentence evidence all the same.
SCORE_WORDS = ["score", "threshold", "ratio", "percentile", "embedding", "distance", "gmm", "knn", "statistical", "statistically", "deviation"]
CONCRETE_WORDS = [
    "hand", "hands", "arm", "arms", "leg", "legs", "head", "torso",
    "floor", "knees", "body", "contact", "push", "shove", "grapple",
    "fight", "hit", "pull", "hold", "restrain", "collapse", "fall",
    "stumble", "lean", "chair", "table", "equipment", "door", "object",
]


def squeezed(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def keywords(c: Column, stop: list[str] = STOPWORDS) -> Column:
    """Distinct lower-case words of three letters or more that aren't stopwords; none of a null text."""
    c = F.coalesce(c, F.lit(""))
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-zA-Z_]{3,}"), F.lit(0))), F.array(*map(F.lit, stop)))


def word_set(c: Column) -> Column:
    """Words at white space, punctuation and brackets stripped from their ends, empty ones left out."""
    words = F.transform(F.split(F.lower(c), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,;:!?()\[\]{}\"']+|[.,;:!?()\[\]{}\"']+$", ""))
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def frame_index(c: Column) -> Column:
    """N of a key that ends in frames/frame_N and an image's extension; 10**9 for any other, so that such keys sort last."""
    n = F.regexp_extract(F.lower(c), r"(?:^|/)frames/frame_([0-9]+)\.(?:jpg|jpeg|png|webp)$", 1)
    return F.when(n == "", F.lit(10**9)).otherwise(n.try_cast("long"))


def score_only(c: Column) -> Column:
    """Whether a sentence speaks of scores and names no concrete thing to be seen; by whole words."""
    has = lambda words: F.lower(F.trim(c)).rlike(r"\b(" + "|".join(words) + r")\b")
    return F.coalesce(has(SCORE_WORDS) & ~has(CONCRETE_WORDS), F.lit(False))


def label_of(video: Column, path: Column) -> Column:
    """1 for an anomaly, 0 for normal: by the id's prefix, else by the path's folder below dataset; null where neither says so.

    The word anywhere in a path says nothing: folders above may have it in their names.
    """
    v, p = F.lower(F.trim(F.coalesce(video, F.lit("")))), F.lower(F.trim(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))))
    return F.when(v.startswith("anomaly__"), 1).when(v.startswith("normal__"), 0).when(p.contains("/dataset/anomaly/"), 1).when(p.contains("/dataset/normal/"), 0)


def loose_label_of(c: Column) -> Column:
    """As label_of, by any whole part of a path, then by the word anywhere in it; anomaly before normal each time."""
    s = F.lower(F.replace(c, F.lit("\\"), F.lit("/")))
    parts = F.split(s, "/")
    whole = lambda w: F.array_contains(parts, w)
    return F.when(whole("anomaly") | whole("anomalous"), 1).when(whole("normal"), 0).when(s.contains("anomaly") | s.contains("anomalous"), 1).when(s.contains("normal"), 0)


def object_reference(c: Column) -> tuple[Column, Column]:
    """Bucket and key of s3://bucket/key; null for anything else."""
    ok = c.rlike(r"^s3://[^/]+/.+$")
    return F.when(ok, F.regexp_extract(c, r"^s3://([^/]+)/", 1)), F.when(ok, F.regexp_extract(c, r"^s3://[^/]+/(.+)$", 1))


def object_key(camera: Column, event: Column, ext: str) -> Column:
    return F.format_string("faces/cam_%s/%s.%s", camera.cast("string"), event.cast("string"), F.lit(ext))


def gate_name(c: Column) -> Column:
    """homography, pose or deep, the first of these that the name contains; else 'unknown'."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(low.contains("homography"), "homography").when(low.contains("pose"), "pose").when(low.contains("deep"), "deep").otherwise("unknown")


def lenient_json(c: Column) -> Column:
    """The outermost {...} of a text without code fences and trailing commas; null if that is no JSON object."""
    inner = F.regexp_extract(F.regexp_replace(c, "```(?:json)?", ""), r"(?s)(\{.*\})", 1)
    fixed = F.regexp_replace(inner, r",\s*([}\]])", "$1")
    return F.when(F.try_parse_json(fixed).isNotNull() & (fixed != ""), fixed)


def vector_literal(v: Column, digits: int = 8) -> Column:
    """[0.12345678,...] with fixed digits, each the exact binary number's, halves to even, as printf writes it; format_string rounds the shortest decimal instead."""
    number = lambda x: F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).otherwise(F.call_function("format_number", x, F.lit("0." + "0" * digits)))
    return F.concat(F.lit("["), F.array_join(F.transform(v, number), ","), F.lit("]"))


def merged(left: Column, right: Column) -> Column:
    """Shallow merge of two maps, the right one's values win."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.coalesce(F.map_contains_key(right, k), F.lit(False))), right)


def finite(c: Column) -> Column:
    """The number, or null if it is NaN or infinite, as JSON has neither."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def write_intent(c: Column) -> Column:
    """Whether a question is a command to change something; a word of a past change anywhere makes it a question."""
    asks = F.lit(False)
    for pattern in WRITE_PATTERNS:
        asks |= c.rlike("(?i)" + pattern)
    return asks & ~c.rlike("(?i)" + PAST_PATTERN)


def evidence_role(c: Column) -> Column:
    """The role of an object key by its name: annotated_frame, tubelet_montage, event_metadata, tubelet_frame, other."""
    low = F.regexp_replace(F.lower(F.trim(c)), "^/+", "")
    name = F.substring_index(low, "/", -1)
    frame = low.rlike(r"(^|/)frames/frame_\d+\.(jpg|jpeg|png|webp)$")
    return F.when(name == "annotated_frame.jpg", "annotated_frame").when(name == "tubelet_montage.jpg", "tubelet_montage").when(name == "event_metadata.json", "event_metadata").when(frame, "tubelet_frame").otherwise("other")


def without_keys(c: Column, keys: list[str]) -> Column:
    """A JSON object without the given top-level keys; null stays null."""
    fields = F.from_json(c, "map<string,string>")
    return F.to_json(F.map_filter(fields, lambda k, _: ~k.isin(*keys)))


def concrete_visual(items: Column) -> Column:
    """Whether sentences, other than those of scores only, name something to be seen."""
    words = lambda s: F.transform(F.split(F.lower(s), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,!?;:()\[\]{}\"']+|[.,!?;:()\[\]{}\"']+$", ""))
    seen = lambda s: F.arrays_overlap(words(s), F.array(*map(F.lit, VISUAL_WORDS)))
    # a sentence that names something is no sentence of scores only, whatever else it says
    return F.coalesce(F.exists(items, seen), F.lit(False))

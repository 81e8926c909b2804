"""Scalar text functions as expressions: they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Technologies and the spellings that name them.
TECHNOLOGIES = {
    "Python": ["python"], "FastAPI": ["fastapi"], "Django": ["django"], "Flask": ["flask"], "PyTorch": ["pytorch"], "TensorFlow": ["tensorflow"], "LangChain": ["langchain"], "SQLite": ["sqlite"],
    "PostgreSQL": ["postgresql", "postgres"], "MySQL": ["mysql"], "Redis": ["redis"], "Kafka": ["kafka"], "MongoDB": ["mongodb"], "JavaScript": ["javascript"], "TypeScript": ["typescript"],
    "React": ["react"], "Vue": ["vue", "vue.js"], "Node.js": ["node.js", "nodejs"], "Docker": ["docker"], "Kubernetes": ["kubernetes", "k8s"],
}
# Where a rule summary may end.
SENTENCE_ENDS = "。！？!?"


def normalize_value(c: Column) -> Column:
    """Trimmed, white space folded to a blank, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " "))


def slug(c: Column) -> Column:
    """Lower case, what is no letter, number or _ folded to -, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", "-"), r"^-+|-+$", "")


def entity_key(kind: str, name: Column) -> Column:
    """kind:slug; null where the name has no word character."""
    s = slug(name)
    return F.when(s != "", F.concat(F.lit(f"{kind}:"), s))


def compact(c: Column) -> Column:
    """Only digits, a to z (after lower-casing) and unified ideographs."""
    return F.regexp_replace(F.lower(c), r"[^0-9a-z一-鿿]+", "")


def bigrams(c: Column) -> Column:
    """The distinct pairs of neighbouring characters; of a single character itself."""
    n, chars = F.length(c), F.split(c, "")
    pairs = F.zip_with(F.slice(chars, F.lit(1), n - 1), F.slice(chars, F.lit(2), n - 1), lambda a, b: F.concat(a, b))
    return F.when(n >= 2, F.array_distinct(pairs)).when(n == 1, F.array(c)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(a) + F.size(b) - both), F.lit(0.0))


def error_text(c: Column) -> Column:
    """Lower case, white space folded, digits as #, 200 characters at most: what repeats of one error share."""
    return F.substring(F.regexp_replace(normalize_value(F.coalesce(c, F.lit(""))), r"(?U)\d+", "#"), 1, 200)


def error_fingerprint(scope: Column, code: Column, message: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", scope, error_text(code), error_text(message)), 256), 1, 16)


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def text_key(c: Column) -> Column:
    """The key of a text imported without a name."""
    return F.concat(F.lit("text:"), F.substring(F.sha2(c, 256), 1, 16))


def community_key(ids: Column) -> Column:
    """Of a set of ids."""
    return F.substring(F.md5(F.array_join(F.array_sort(ids), ",")), 1, 12)


def first_number(c: Column) -> Column:
    return F.regexp_extract(c, r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def without_angles(c: Column) -> Column:
    """Special tokens as ordinary text: <|x|> becomes |x|."""
    return F.regexp_replace(c, r"<(\|[^|<>]{0,32}\|)>", "$1")


def iso(c: Column) -> Column:
    """ISO 8601 in UTC with microseconds, so that texts sort as times do."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def headings(c: Column) -> Column:
    """The headings of levels 1 to 3 of a Markdown text."""
    return F.regexp_extract_all(c, F.lit(r"(?m)^#{1,3}[ \t]+(.+?)[ \t]*#*[ \t]*$"), F.lit(1))


def links(c: Column) -> Column:
    """The targets of Markdown links to http(s)."""
    return F.regexp_extract_all(c, F.lit(r"\[[^\]]+\]\((https?://[^)]+)\)"), F.lit(1))


def technologies(c: Column) -> Column:
    """The technologies a text names, as words of their own."""
    low = F.lower(c)
    quoted = lambda s: s.replace(".", r"\.")
    named = [F.when(low.rlike(f"(?<![a-z0-9])(?:{'|'.join(map(quoted, n))})(?![a-z0-9])"), F.lit(t)) for t, n in TECHNOLOGIES.items()]
    return F.array_compact(F.array(*named))


def chunks(c: Column, most: int = 2000) -> Column:
    """The text in pieces of whole lines, of `most` characters at most unless a line alone is longer."""
    lines = F.regexp_extract_all(c, F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(at: Column, line: Column) -> Column:
        full = (at["open"] != "") & (F.length(at["open"]) + F.length(line) > most)
        return F.struct(F.when(full, F.concat(at["done"], F.array(at["open"]))).otherwise(at["done"]).alias("done"), F.when(full, line).otherwise(F.concat(at["open"], line)).alias("open"))

    return F.aggregate(lines, start, add, lambda at: F.when(at["open"] == "", at["done"]).otherwise(F.concat(at["done"], F.array(at["open"]))))


def facts(c: Column) -> Column:
    """The items of a JSON array in the text, else its lines without list marks."""
    listed = F.from_json(F.regexp_extract(c, r"(?s)\[.*\]", 0), "array<string>")
    clean = lambda a: F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x != "")
    lines = F.transform(F.filter(F.split(c, r"\r?\n"), lambda x: F.trim(x) != ""), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^[-*0-9. ]+", "")))
    return F.when(F.size(clean(listed)) > 0, clean(listed)).otherwise(lines)


def rule_summary(c: Column, length: int = 120) -> Column:
    """The first `length` characters, cut after the last sentence end, with the length of the whole; short texts as they are."""
    head = F.substring(c, 1, length)
    ended = F.regexp_extract(head, f"(?s)^.+[{SENTENCE_ENDS}]", 0)
    return F.when(F.length(c) <= length, c).otherwise(F.concat(F.when(F.length(ended) > 1, ended).otherwise(head), F.lit("…(原文共 "), F.length(c).cast("string"), F.lit(" 字)")))

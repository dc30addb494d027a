"""Text functions as Column expressions; every pattern gives the same result in Java and RE2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that carry no content, in natural order.
STOPWORDS = tuple(
    """a an the of to in on at is are was were be been being and or but if then this
    that these those it its as for with by from into about over under we you they he
    she i me my our your their them his her do does did how what why when where which
    who whom can could should would will shall may might must not no yes some any all
    each more most other than there here also so such only very
    mujhe mein hindi me ko ka ki ke hai ho kya kyon kaise batao samjhao samjhaye samjha
    aur ek""".split()
)
# The request patterns of each intent, the first intent that matches wins.
INTENTS = (
    ("simplify", (r"\bsimplif", r"\beasier\b", r"\bsimple\b", r"\bsaral\b", r"\baasaan\b", r"\basaan\b", r"\bsamjh", r"\bchild\b", r"\bkid", r"\bbacch")),
    ("explain", (r"\bexplain", r"\bwhat is\b", r"\bwhat are\b", r"\bhow does\b", r"\bdescribe\b", r"\bsamjha", r"\bbatao\b", r"\bkya hai\b", r"\bkya hota\b")),
)
DEFAULT_INTENT = "answer"
#: Unicode white space as Python's ``str.split`` knows it.
SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TOKEN = r"[\p{L}\p{N}_]+"
WORD = f"[^{SPACE}]+"
TRIM = f"^[{SPACE}]+|[{SPACE}]+$"
SENTENCE = r"(?s).*?[.!?।]+[\s\"')\]]*|.+"
TRANSLATION_BREAK = r"([.!?।])[\s]+"
BREAK_MARK = "\x1e"
REFUSAL = r"(?i)no[_ ]answer[_ ]in[_ ]source"
PREAMBLE = r"(?i)^\s*here(?:['’`]s| is)(?:[^\p{L}\p{N}_:\n][^:\n]{0,79})?:\s*"
EMPTY_BRACKETS = r"\(\s*\)|\[\s*\]"


def bounded(pattern: str) -> str:
    r"""A pattern with ``\b`` written out, so that all dialects take letters of any script as word characters."""
    out = pattern
    if out.startswith(r"\b"):
        out = r"(?:^|[^\p{L}\p{N}_])" + out[2:]
    if out.endswith(r"\b"):
        out = out[:-2] + r"(?:$|[^\p{L}\p{N}_])"
    return out


INTENT_PATTERNS = tuple((name, "|".join(bounded(p) for p in patterns)) for name, patterns in INTENTS)


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, TRIM, "")


def all_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def content_tokens(c: Column) -> Column:
    """Lower-cased words of three characters or more that carry content, in order."""
    return F.filter(all_tokens(c), lambda t: (F.length(t) > 2) & ~t.isin(*STOPWORDS))


def words(c: Column) -> Column:
    """Runs of characters between white space."""
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def normal_space(c: Column) -> Column:
    return F.array_join(words(c), " ")


def intent(request: Column) -> Column:
    r = F.lower(request)
    out = None
    for name, pattern in INTENT_PATTERNS:
        out = F.when(r.rlike(pattern), name) if out is None else out.when(r.rlike(pattern), name)
    return out.otherwise(DEFAULT_INTENT)


def sentences(c: Column) -> Column:
    """Sentences with their end marks, trimmed; what follows the last mark is one too."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(SENTENCE), F.lit(0)), trimmed), lambda s: s != "")


def translation_units(c: Column) -> Column:
    """Sentences that white space divides; marks inside a word divide nothing."""
    marked = F.regexp_replace(trimmed(c), TRANSLATION_BREAK, "$1" + BREAK_MARK)
    return F.filter(F.transform(F.split(marked, BREAK_MARK), trimmed), lambda s: s != "")


def is_refusal(c: Column) -> Column:
    """Empty, or led by the sentinel."""
    t = trimmed(F.coalesce(c, F.lit("")))
    return (t == "") | t.rlike("^(?:" + REFUSAL + ")")


def clean_answer(c: Column) -> Column:
    """Without a preamble, leaked sentinels and brackets they leave empty."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), PREAMBLE, "")
    return trimmed(F.regexp_replace(F.regexp_replace(t, REFUSAL, ""), EMPTY_BRACKETS, ""))


def language_code(c: Column) -> Column:
    """English is upper-case, all others are lower-case."""
    return F.when(F.lower(c) == "en", "EN").otherwise(F.lower(c))


def citation(content_id: Column, chapter: Column, section: Column, page: Column, prefix: str = "SOURCE") -> Column:
    return F.concat(F.lit(prefix + " "), F.coalesce(content_id, F.lit("unknown")), F.lit(" · "), F.coalesce(chapter, F.lit("")), F.lit(" · "), F.coalesce(section, F.lit("")), F.lit(" (p."), F.coalesce(page, F.lit(0)).cast("string"), F.lit(")"))


def spoken(localized: Column, english: Column) -> Column:
    """The localized text, or the English one where that is missing or empty."""
    return F.coalesce(F.nullif(localized, F.lit("")), english)


def first_of(values: Column, default: Column) -> Column:
    """First value of a list, or the default where there is none."""
    return F.coalesce(F.nullif(F.try_element_at(values, F.lit(1)), F.lit("")), default)


def first_clause(c: Column) -> Column:
    return F.substring_index(c, ".", 1)


def passage_prefix(text: Column, kind: str, backend: str) -> Column:
    """Neural embedders tell queries from passages by a prefix; others take the text as it is."""
    return F.concat(F.lit(f"{kind}: "), text) if backend in ("onnx", "sentence-transformers") else text


def masked(c: Column, keep: int = 4) -> Column:
    """A secret with all but its first characters hidden."""
    return F.concat(F.substring(c, 1, keep), F.repeat(F.lit("*"), F.greatest(F.length(c) - keep, F.lit(0))))


def rebased(url: Column, base: str) -> Column:
    """The path of a URL under another base."""
    return F.concat(F.lit(base.rstrip("/")), F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*", ""))


def suffixed(prompt: Column, suffix: str) -> Column:
    """A prompt with an instruction after it."""
    return F.concat(prompt, F.lit(suffix))


def two_digits(score: Column) -> Column:
    """A score to two digits."""
    return F.format_string("%.2f", score)


def milliseconds(seconds: Column) -> Column:
    """A time in whole milliseconds, as it is shown."""
    return F.concat(F.round(seconds * 1000).cast("bigint").cast("string"), F.lit(" ms"))

"""Text, year and code expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space.
BLANK = r"(?U)\s+"
#: Behaviour switches, and where a sentence ends.
SWITCH, SENTENCE = r"__[A-Z_]+__", r"[.!?]\s+[A-Z]"
#: Title prefixes of pages that are no articles.
NAMESPACES = (
    "talk", "user", "user talk", "wikipedia", "wp", "wikipedia talk", "file", "image", "file talk", "mediawiki", "mediawiki talk", "template", "template talk", "help", "help talk",
    "category", "category talk", "portal", "portal talk", "draft", "draft talk", "timedtext", "timedtext talk", "module", "module talk", "book", "book talk", "special",
)
#: What removed templates leave behind, and what stays of it, in this order.
TIDY = ((r"\(\s*[;,:\s]+", "("), (r"[;,:\s]+\)", ")"), (r"\(\s*\)", ""), (r"\s+([,.;:])", "$1"), (r"\n{3,}", "\n\n"), (r"[ \t]+", " "))


def word_count(text: Column) -> Column:
    """Words between Unicode white space; 0 for empty, null for null."""
    return F.when(text.isNotNull(), F.size(F.array_remove(F.split(text, BLANK), "")))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANK, " "))


def clean_lead(text: Column) -> Column:
    """Without behaviour switches such as __TOC__, white space squeezed; null stays null."""
    return squeeze(F.regexp_replace(text, SWITCH, ""))


def sentence_count(text: Column) -> Column:
    """One more than sentence ends followed by a capital; 0 for a blank text, null for null."""
    return F.when(~text.rlike(r"(?U)\S"), 0).when(text.isNotNull(), 1 + F.regexp_count(text, F.lit(SENTENCE)))


def tidy_lead(text: Column) -> Column:
    """Loose punctuation that removed templates leave behind."""
    for pattern, put in TIDY:
        text = F.regexp_replace(text, pattern, put)
    return text


def normalize_title(target: Column) -> Column:
    """A link target as a page title: no leading colon, no fragment, blanks for underscores, first letter upper case."""
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    t = F.regexp_replace(trim(target), r"(?U)^:\s*", "")
    t = trim(F.translate(F.substring_index(t, "#", 1), "_", " "))
    return F.get(F.transform(F.array(t), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), F.lit(0))


def is_skip_namespace(title: Column) -> Column:
    at = F.instr(title, ":")
    return (at > 1) & F.lower(F.trim(F.substring_index(title, ":", 1))).isin(*NAMESPACES)


def parse_year(time: Column) -> Column:
    """Signed year of +1879-03-14T... or -0044-...; null without a digit run up to a hyphen."""
    year = F.regexp_extract(time, r"^.([0-9]+)-", 1).try_cast("int")
    return F.when(F.startswith(time, F.lit("-")), -year).otherwise(year)


def ordinal(n: Column) -> Column:
    teen = F.pmod(F.floor(n / 10), F.lit(10)) == 1
    end = F.when(teen, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def century(year: Column) -> Column:
    """Century label of a year, rounded half to even; year 0 is the 0th century BCE."""
    y = F.bround(year, 0).cast("long")
    return F.when(y > 0, F.concat(ordinal(F.floor((y - 1) / 100) + 1), F.lit(" century"))).otherwise(F.concat(ordinal(F.floor((-y - 1) / 100) + 1), F.lit(" century BCE")))


def year_label(year: Column) -> Column:
    return F.when(year < 0, F.concat((-year).cast("string"), F.lit(" BCE"))).otherwise(year.cast("string"))


def life_span(birth: Column, death: Column) -> Column:
    """Both years, one if equal, d. or b. if one is known, empty if none."""
    b, d = year_label(birth), year_label(death)
    return F.when(birth.isNotNull() & death.isNotNull(), F.when(birth == death, d).otherwise(F.concat(b, F.lit(" – "), d))).when(death.isNotNull(), F.concat(F.lit("d. "), d)).when(birth.isNotNull(), F.concat(F.lit("b. "), b)).otherwise("")


def era_label(year: Column, now: int = 2000) -> Column:
    """An era on a compass: about which year, or the present."""
    return F.when(year >= now, "the present").when(year < 0, F.concat(F.lit("c."), (-year).cast("string"), F.lit(" BCE"))).otherwise(F.concat(F.lit("c."), year.cast("string")))


def figure_era(birth: Column, death: Column) -> Column:
    """The same of a death year, else a birth year, with no present; empty without both."""
    year = F.coalesce(death, birth)
    return F.when(year.isNull(), "").when(year < 0, F.concat(F.lit("c."), (-year).cast("string"), F.lit(" BCE"))).otherwise(F.concat(F.lit("c."), year.cast("string")))


def unescape_html(text: Column) -> Column:
    """The inverse of escape_html."""
    for a, b in (("&quot;", '"'), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def article_url(title: Column, base: str = "https://en.wikipedia.org/wiki/") -> Column:
    """Blanks as underscores, then encoded as a URI component."""
    out = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.concat(F.lit(base), out)


def match_phrase(text: Column, phrases: list[str], ignore: list[str] = []) -> Column:
    """The first phrase on word boundaries that isn't to be ignored, the longest at each place; null without one."""
    ordered = sorted({*phrases, *ignore}, key=lambda p: (-len(p), p))
    if not ordered:
        return F.lit(None).cast("string")
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\b(" + "|".join(_quoted(p) for p in ordered) + r")\b"), F.lit(1))
    return F.get(F.filter(found, lambda x: ~x.isin(*ignore)) if ignore else found, F.lit(0))


def _quoted(phrase: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in phrase)


def code_of(value: Column, names: tuple[str, ...], default: int) -> Column:
    """Place of a name in a list, as a short."""
    table = F.create_map(*(x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))))
    return F.coalesce(F.try_element_at(table, value), F.lit(default)).cast("smallint")


def to_byte(fraction: Column) -> Column:
    """[0, 1] onto 0..255, rounded half to even."""
    return F.least(F.greatest(F.bround(fraction * 255, 0), F.lit(0)), F.lit(255)).cast("smallint")


def angle_byte(angle: Column) -> Column:
    return F.pmod(F.bround(angle / (2 * F.pi()) * 256, 0).cast("long"), F.lit(256)).cast("smallint")

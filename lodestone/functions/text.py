"""Column functions over text: tokens, stems, sentences, cuts, hashes and fences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fused words and their parts.
FUSED = {
    "webchat": ["web", "chat"],
    "codebase": ["code", "base"],
    "filesystem": ["file", "system"],
    "darkmode": ["dark", "mode"],
    "lightmode": ["light", "mode"],
    "datatype": ["data", "type"],
    "filepath": ["file", "path"],
    "filename": ["file", "name"],
}
#: Characters of text that count as one token.
CHARS_PER_TOKEN = 3.2


def tokenize(text: Column) -> Column:
    """Distinct lower-case words of 2 to 40 letters and digits in first-seen order: whole words, then the parts of
    camel-case words, then the parts of fused words. A null text gives null."""
    fit = lambda words: F.filter(words, lambda w: F.length(w).between(2, 40))
    # words are made distinct first, and only texts with a border inside a word (or a letter that becomes an ASCII one
    # in lower case) are cut a second time; words are taken out by their own ASCII class, since Java is many times slower
    # to cut at a negated one of several ranges
    runs = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"\p{Alnum}{2,}"), F.lit(0)))
    whole = fit(F.transform(runs(text), F.lower))
    apart = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    inner = F.when(text.rlike("[a-z0-9][A-Z]|[A-Z]{2}[a-z]|[\u212a\u0130]"), fit(runs(F.lower(apart))))
    pieces = F.array_distinct(F.concat(whole, F.coalesce(inner, F.array().cast("array<string>"))))
    table = F.create_map(*[x for k, v in FUSED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])

    def with_parts(p: Column) -> Column:
        fused = F.array_intersect(p, F.array(*map(F.lit, FUSED)))
        parts = F.flatten(F.transform(fused, lambda w: F.element_at(table, w)))
        return F.when(F.size(fused) > 0, F.array_distinct(F.concat(p, parts))).otherwise(p)

    return once(pieces, with_parts)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed a single time, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stem(word: Column) -> Column:
    """A lower-case word without its common English endings; words of up to three letters stay."""
    w = F.lower(word)
    ends = lambda c, s: F.endswith(c, F.lit(s))
    less = lambda c, n: F.left(c, F.length(c) - n)
    soft = lambda c: ends(c, "at") | ends(c, "bl") | ends(c, "iz")
    doubled = lambda c: (F.length(c) >= 3) & (F.right(c, F.lit(1)) == F.substring(c, -2, 1))
    ed, ing, er = less(w, 2), less(w, 3), less(w, 2)
    return (
        F.when(F.length(w) <= 3, w)
        .when(ends(w, "sses"), less(w, 2))
        .when(ends(w, "ies"), F.concat(less(w, 3), F.lit("y")))
        .when(ends(w, "ss"), w)
        .when(ends(w, "s") & ~ends(w, "us") & ~ends(w, "is"), less(w, 1))
        .when(ends(w, "eed") & (F.length(w) > 4), less(w, 1))
        .when(ends(w, "ed") & (F.length(w) > 4), F.when(soft(ed), F.concat(ed, F.lit("e"))).otherwise(ed))
        .when(ends(w, "ing") & (F.length(w) > 5), F.when(soft(ing), F.concat(ing, F.lit("e"))).when(doubled(ing), less(ing, 1)).otherwise(ing))
        .when(ends(w, "er") & (F.length(w) > 4), F.when(doubled(er), less(er, 1)).otherwise(er))
        .otherwise(w)
    )


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(" \t\n\u000b\f\r"))


def sentences(text: Column) -> Column:
    """Sentence-like units: cut at white space after . ! or ? before an opener, and at blank lines; never empty."""
    parts = F.filter(F.transform(F.split(text, "(?<=[.!?])\\s+(?=[A-Z(\\[\"'`*_])|\\n{2,}"), trimmed), lambda s: s != "")
    return once(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(text)))


def estimate_tokens(text: Column) -> Column:
    """The default token counter."""
    return F.ceil(F.length(text) / F.lit(CHARS_PER_TOKEN)).cast("bigint")


def truncate_sentence(text: Column, most: int) -> Column:
    """At most ``most`` characters: up to the last sentence end if beyond the half, else with an ellipsis."""
    cut = F.left(text, F.lit(most))
    at = lambda mark: F.length(cut) - F.locate(mark, F.reverse(cut)) - 1  # noqa: E731  0-based place of the last mark
    last = F.greatest(*[F.when(F.locate(m, F.reverse(cut)) > 0, at(m)).otherwise(F.lit(-1)) for m in (" .", "\n.")])
    return F.when(F.length(text) <= most, text).when(last > most / 2, F.left(cut, last + 1)).otherwise(F.concat(trimmed(cut), F.lit("…")))


def extract_abstract(text: Column, most: int = 1200) -> Column:
    """The labelled abstract up to the next heading, else the first paragraph that is not a heading, image or quote."""
    labelled = trimmed(F.regexp_extract(text, r"(?is)(?:^|\n)#{0,6}\s*\*{0,2}abstract\*{0,2}\s*[:.\n-]+\s*(.*?)(?=\n#{1,6}\s|$)", 1))
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), trimmed), lambda p: (p != "") & ~F.substring(p, 1, 1).isin("#", "!", ">"))
    return truncate_sentence(F.when(labelled != "", labelled).otherwise(F.coalesce(F.get(paragraphs, F.lit(0)), F.lit(""))), most)


def preview(text: Column, lines: int = 25, chars: int = 800) -> Column:
    """The first lines, trimmed, cut with a mark."""
    head = trimmed(F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n"))
    return F.when(F.length(head) > chars, F.concat(F.left(head, F.lit(chars)), F.lit(" …"))).otherwise(head)


def tail(text: Column, chars: int = 12_000, mark: str = "… (earlier output omitted)\n") -> Column:
    """The end of a text, behind a mark if it was cut."""
    return F.when(F.length(text) > chars, F.concat(F.lit(mark), F.right(text, F.lit(chars)))).otherwise(text)


def truncate_document(text: Column, chars: int = 400_000, mark: str = "\n\n[TRUNCATED: the document is longer than the limit]") -> Column:
    return F.when(F.length(text) > chars, F.concat(F.left(text, F.lit(chars)), F.lit(mark))).otherwise(text)


def safe_fence(text: Column) -> Column:
    """A fence one backtick longer than the longest run of three or more in the text."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(`{3,})")), F.length)), F.lit(2))
    return F.repeat(F.lit("`"), F.greatest(longest + 1, F.lit(3)))


def content_hash(text: Column) -> Column:
    return F.left(F.sha1(text), F.lit(8))


def strip_ansi(text: Column) -> Column:
    """Without terminal escape sequences."""
    return F.regexp_replace(text, "\u001b\\[[0-9;?]*[ -/]*[@-~]", "")


def salvage_json(reply: Column) -> Column:
    """The JSON object in a reply: inside a fence if there is one, from the first { to the last }, as it stands if it
    parses, else without the commas before a closing bracket, if that parses. Null where there is none; an object that
    repeats a key counts as none."""
    fence = r"(?is)```(?:json)?\s*(.*?)```"
    body = F.when(reply.rlike(fence), F.regexp_extract(reply, fence, 1)).otherwise(reply)
    inner = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    # as the element of a list, so that nothing may follow the object
    parses = lambda c: F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))).isNotNull()
    loose = F.regexp_replace(inner, r",(\s*[}\]])", "$1")
    return F.when(inner == "", None).when(parses(inner), inner).when(parses(loose), loose)


def insert_instruction(prompt: Column, text: Column, heading: str = "## Output") -> Column:
    """``text`` before the last output heading, or at the end where there is none."""
    at = F.length(prompt) - F.locate(heading[::-1], F.reverse(prompt)) - len(heading) + 1
    found = F.locate(heading[::-1], F.reverse(prompt)) > 0
    put = F.concat(F.left(prompt, at), text, F.lit("\n\n"), F.substring(prompt, at + 1, F.length(prompt)))
    return F.when((prompt == "") | (text == ""), prompt).when(found, put).otherwise(F.concat(prompt, F.lit("\n\n"), text))


def l2_normalize(vector: Column) -> Column:
    """Divided by its Euclidean norm; a zero vector stays."""
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: x / norm))

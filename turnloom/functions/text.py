"""Scalar text functions as Columns: tokenizers, stems, token estimates, splits, routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the tokenizers leave out.
QUERY_STOP = """a an the and or of to in on at for from with by about as is are was were be been being
do does did done have has had having i me my mine we our you your he she it its they them
their this that these those there here which what when where who whom whose how why
many much more most some any all each every than then so if but not no nor only own same
too very can will just should would could may might must also into over under again
first last before after earlier later happened happen order time ago days day weeks week
months month years year between during while since until once ever never
tell remember recall mention mentioned said say told""".split()
LEXICAL_STOP = """a an the and or but if in on at to for of is are was were be been being
this that these those it its as with by from into about than then so
not no nor do does did doing done have has had having i you he she we
they them my your our their what which who whom how when where why""".split()
FTS_STOP = """a an the and or of to in on at for from with by about as is are was were be been am do does did
have has had i me my we our you your he she it its they them their this that these those there
which what when where who whom how why so if but not no than then can will would could should
may might must also into over under again""".split()
#: What makes a sentence a candidate claim, or a preference.
CLAIM_TRIGGERS = ("i ", "my ", "prefer", "always", "never", "on ", "was ", "were ", "have ", "use ", "using ")
CLAIM_CHARS = 20
PREFERENCE = ("prefer", "always", "never", "from now on", "i like")
#: Tokens are estimated as letter runs, digits and symbols, plus five per cent.
PIECE = r"[A-Za-z]+|[0-9]|[^\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}A-Za-z0-9]"


def _words(words: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in words])


def _stops(words: list[str], t: Column) -> Column:
    """Whether ``t`` is one of ``words``; the list is one literal, as it stands in many plans."""
    return F.array_contains(F.split(F.lit(" ".join(words)), " "), t)


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def query_tokens(text: Column) -> Column:
    """Distinct lower-case tokens of three or more characters that aren't stop words, in order."""
    raw = F.transform(_matches(F.lower(text), "[a-z0-9][a-z0-9'-]*"), lambda t: F.regexp_replace(t, "^['-]+|['-]+$", ""))
    return F.array_distinct(F.filter(raw, lambda t: (F.length(t) >= 3) & ~_stops(QUERY_STOP, t)))


def stem(token: Column) -> Column:
    """Lower case without 's, edge marks and one final ing or ed; the first five characters."""
    t = F.regexp_replace(F.replace(F.lower(token), F.lit("'s"), F.lit("")), "^['-]+|['-]+$", "")
    return F.left(F.regexp_replace(t, "^(.{3,})(?:ing|ed)$", "$1"), F.lit(5))


def stemmed_words(text: Column) -> Column:
    """Every run of a-z, 0-9 and ' in lower case, stemmed; one may become empty and stays. Of words
    without a ' only the ending and the length matter, which no expression is needed for."""
    n = F.length
    cut = lambda t: F.when((n(t) >= 6) & t.endswith("ing"), F.left(t, n(t) - 3)).when((n(t) >= 5) & t.endswith("ed"), F.left(t, n(t) - 2)).otherwise(t)
    return F.transform(_matches(F.lower(text), "[a-z0-9']+"), lambda t: F.when(F.contains(t, F.lit("'")), stem(t)).otherwise(F.left(cut(t), F.lit(5))))


def lexical_tokens(text: Column) -> Column:
    """Letter runs of two or more that aren't stop words, without a plural s."""
    raw = F.filter(
        _matches(F.lower(text), r"[\p{L}\p{Nl}\p{No}]+"),
        lambda t: (F.length(t) >= 2) & ~t.isin(*LEXICAL_STOP),
    )
    plural = lambda t: (F.length(t) > 4) & t.endswith("s") & ~t.endswith("ss")
    return F.transform(raw, lambda t: F.when(plural(t), F.left(t, F.length(t) - 1)).otherwise(t))


def fts_terms(text: Column) -> Column:
    """At most 16 distinct words for the OR search."""
    raw = F.transform(_matches(text, "[A-Za-z0-9][A-Za-z0-9'_-]*"), lambda t: F.lower(F.regexp_replace(t, "^['_-]+|['_-]+$", "")))
    kept = F.filter(raw, lambda t: (F.length(t) >= 2) & ~_stops(FTS_STOP, t))
    return F.slice(F.array_distinct(kept), 1, 16)


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.lit(1.05) * F.regexp_count(text, F.lit(PIECE))).cast("long")


def sentences(text: Column) -> Column:
    """Split after . ! ? and at newlines; trimmed, without empty ones."""
    # a lambda, as trim itself takes a second argument and would be given each sentence's place to strip
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def clauses(text: Column) -> Column:
    """Split at sentence ends, newlines, commas, semicolons and and/but/while; a date's comma holds."""
    whole = F.regexp_replace(text, r"([0-9]{1,2}(?:st|nd|rd|th)?),\s+([0-9]{4})\b", "$1 $2")
    parts = F.split(whole, r"(?i)(?<=[.!?])\s+|\n+|[,;]\s+|\s+(?:and|but|while)\s+")
    return F.filter(parts, lambda c: F.trim(c) != "")


def normal_claim(text: Column) -> Column:
    """A claim as it is compared: case folded (ß as ss, a final sigma as any other), white space collapsed."""
    folded = F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))
    return F.trim(F.regexp_replace(folded, r"\s+", " "))


def with_options(query: Column, options: Column) -> Column:
    """``query`` with the ``options`` to choose from on lines of their own; without any, as it is."""
    some = F.coalesce(F.size(options), F.lit(0)) > 0
    return F.when(some, F.concat_ws("\n", query, F.lit("Options:"), F.array_join(options, "\n"))).otherwise(query)


def clipped(text: Column, limit: int) -> Column:
    """White space collapsed; cut to ``limit`` characters, the last an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.left(flat, F.lit(limit - 1)), F.lit("…")))


def first_entity(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?<![\p{L}\p{N}_])([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)(?![\p{L}\p{N}_])", 1)
    return F.when(found != "", found)


def is_claim(sentence: Column) -> Column:
    low = F.lower(sentence)
    return (F.length(sentence) >= CLAIM_CHARS) & F.exists(_words(list(CLAIM_TRIGGERS)), lambda w: F.contains(low, w))


def is_preference(text: Column) -> Column:
    low = F.lower(text)
    return F.exists(_words(list(PREFERENCE)), lambda w: F.contains(low, w))


def once(column: Column) -> Column:
    """``column`` by a generator of one row, so that filters and columns after it use what was made and
    don't make it anew. A select takes one of these; put several columns into a struct."""
    return F.explode(F.array(column))


def stem_hits(tokens: Column, text: Column) -> Column:
    """How many of ``tokens`` have their stem in ``text``."""
    return stems_in(F.transform(tokens, stem), text)


def stems_in(stems: Column, text: Column) -> Column:
    """How many of ``stems`` are in ``text``, whose lower case is taken once and not for each of them."""
    low = F.array(F.lower(text))
    return F.element_at(F.transform(low, lambda low: F.size(F.filter(stems, lambda t: F.contains(low, t)))), 1).cast("long")


def densest_hits(text: Column, tokens: Column, window: int = 320) -> Column:
    """The most token hits within any window of ``window`` characters, half a window apart."""
    step = window // 2
    # bound in a struct, as a lambda would make both anew for each window
    bound = F.array(F.struct(F.lower(text).alias("low"), F.transform(tokens, stem).alias("stems")))

    def most(x):
        last = F.greatest(F.lit(0), F.length(x["low"]) - window + step - 1)
        return F.array_max(F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda s: stems_in(x["stems"], F.substr(x["low"], s + 1, F.lit(window)))))

    return F.element_at(F.transform(bound, most), 1)


def sides(query: Column) -> Column:
    """One or two token lists: the named events of a comparison. A side ends at a newline (d)."""
    between = r"(?id)\bbetween\s+(.+?)\s+and\s+(.+?)(?:\?|$)"
    since = r"(?id)\bsince\s+(.+?)\s+when\s+(.+?)(?:\?|$)"
    pair = lambda p: F.array(*[F.regexp_extract(query, p, k) for k in (1, 2)])
    parts = F.split(query, r"(?i)\bor\b")
    left, right = parts[0], F.when(F.size(parts) == 2, F.try_element_at(parts, F.lit(2)))
    either = [F.array(x, right) for x in (F.element_at(F.split(left, "[,:;]"), -1), left)]
    # the first way to part the question that gives every side a token
    ways = F.transform(F.array(pair(between), pair(since), *either, F.array(query)), lambda way: F.transform(way, query_tokens))
    found = F.filter(ways, lambda way: F.coalesce(F.forall(way, lambda x: F.size(x) > 0), F.lit(False)))
    return F.when(query.isNotNull(), F.coalesce(F.try_element_at(found, F.lit(1)), F.array(F.array().cast("array<string>"))))


#: The patterns that route a question, in the order in which they are tried.
ABILITIES = (
    ("contradiction", r"contradict|which(?:\s+\w+){0,3}\s+is correct|clarify which|inconsistent|you said"),
    ("event_ordering", r"\border\b|sequence|which came first|timeline|before or after"),
    ("temporal", r"\bwhen\b|how many days|what date|before .* after|ago\b"),
    ("preference", r"prefer|favorite|always|never|from now on"),
    ("extraction", r"what (?:is|was|did)|who |which |name of|tell me about my"),
)
HISTORICAL = ("contradiction", "temporal", "event_ordering")


def ability(query: Column) -> Column:
    low, made = F.lower(query), None
    for name, pattern in ABILITIES:
        made = F.when(low.rlike(pattern), name) if made is None else made.when(low.rlike(pattern), name)
    return made.otherwise("default")


def ability_k(name: Column, k: int) -> Column:
    return (
        F.when(name.isin(*HISTORICAL), max(k, 16)).when(name == "abstention", min(k, 6)).otherwise(k).cast("long")
    )


#: The countable words, and number words, of a requested list.
NUMBERS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
COUNTABLE = "(?:items?|events?|aspects?|steps?|points?|things?)"
MENTIONS = r"(?i)\b(?:brought\s+up|mentioned|discussed|talked\s+about|asked\s+about)\b"


def requested_length(question: Column) -> Column:
    digits = F.regexp_extract(question, rf"(?i)\b([0-9]+)\s+{COUNTABLE}\b", 1)
    made = F.when(digits != "", F.try_to_number(digits, F.lit("999999999")).cast("long"))
    for n, word in enumerate(NUMBERS, 1):
        made = made.when(question.rlike(rf"(?i)\b{word}\s+{COUNTABLE}\b"), n)
    return made

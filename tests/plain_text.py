"""Text rules for the plain versions, by scanning characters; only word lists come from the library."""

from turnloom.functions.text import QUERY_STOP

DIGITS, SMALL = "0123456789", "abcdefghijklmnopqrstuvwxyz"
LETTERS = SMALL + SMALL.upper()


def runs(text, first, more=None, least=1):
    """Stretches that open with a character of ``first`` (a test) and go on with ``more``."""
    more, found, i = more or first, [], 0
    while i < len(text):
        j = i
        if first(text[i]):
            j = i + 1
            while j < len(text) and more(text[j]):
                j += 1
        if j - i >= least:
            found.append(text[i:j])
            i = j
        else:
            i += 1
    return found


def once(items):
    seen = []
    for x in items:
        if x not in seen:
            seen.append(x)
    return seen


def tokens(text):
    """Lower-case words of three characters or more that say something, each once."""
    plain = SMALL + DIGITS
    words = [w.strip("'-") for w in runs(text.lower(), plain.__contains__, (plain + "'-").__contains__)]
    return once(w for w in words if len(w) > 2 and w not in QUERY_STOP)


def in_word(c):
    return c.isalnum() or c == "_"


def places(text, word):
    """Where ``word`` stands by itself, whatever its case."""
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found, at = [], low.find(word)
    while at >= 0:
        end = at + len(word)
        if not (at and in_word(text[at - 1])) and not (end < len(text) and in_word(text[end])):
            found.append(at)
        at = low.find(word, at + 1)
    return found


def two_events(text, opener, closer):
    """What stands on one line between the two words, and behind the second up to a question mark."""
    blank = lambda i: i < len(text) and text[i].isspace()
    for start in places(text, opener):
        begin = start + len(opener)
        for at in places(text, closer):
            end = at + len(closer)
            if at <= begin or not (blank(begin) and blank(at - 1) and blank(end)):
                continue
            one, rest = text[begin:at], text[end:].lstrip()
            inner = one.strip()
            if "\n" in inner or (not inner and (len(one) < 3 or one[1:-1].strip("\n") == "")) or not rest:
                continue
            stop = rest.find("?", 1)
            two = rest if stop < 0 else rest[:stop]
            if stop < 0 and two.endswith("\n"):
                two = two[:-1]
            if two and "\n" not in two:
                return inner, two
    return None


def sides(text):
    """The token lists of the events that a question compares: two of them, or the question's own."""
    for words in (("between", "and"), ("since", "when")):
        found = two_events(text, *words)
        if found and all(map(tokens, found)):
            return [tokens(x) for x in found]
    at = places(text, "or")
    if len(at) == 1:
        left, right = text[: at[0]], text[at[0] + 2 :]
        mark = max(left.rfind(c) for c in ",:;")
        pair = [tokens(left[mark + 1 :]) or tokens(left), tokens(right)]
        if all(pair):
            return pair
    return [tokens(text)]


def quoted(text):
    found, i = [], 0
    while i < len(text):
        j = text.find(text[i], i + 1) if text[i] in "'\"" else -1
        if j > 0 and 3 <= j - i - 1 <= 80:
            found.append(text[i + 1 : j].strip())
            i = j
        i += 1
    return found


def word_searches(query):
    """The word searches of a question beside its own: that of its long words, then those of its
    names, its quoted phrases and the two sides of an alternative."""
    long = [w for w in runs(query, lambda c: not c.isspace() and c != '"') if len(w) >= 4]
    names = [w for w in runs(query, lambda c: not c.isspace()) if w[0].isupper() and len(w) >= 3]
    more = names[:4] + quoted(query)
    at = places(query, "or")
    if len(at) == 1:
        for side in (query[: at[0]], query[at[0] + 2 :]):
            words = [w for w in runs(side, LETTERS.__contains__, (LETTERS + DIGITS + "'-").__contains__, 3) if len(w) >= 4]
            more.append(" ".join(words[-4:]))
    return " ".join(long[:8]), [w for w in more if w.strip()]

"""The pseudonyms again, one value at a time in plain Python."""

import hashlib
from datetime import date, datetime, timedelta

import regex

from turnloom.llm.pii import PATTERNS

START, DAYS = date(1800, 1, 1), 146097
ANY = regex.compile("|".join(PATTERNS.values()), regex.A)
LATE = [d for d in (START + timedelta(k) for k in range(DAYS)) if d.day > 12]
LATE_AT = {d: k for k, d in enumerate(LATE)}


def keyed(key, *parts):
    inner = hashlib.sha256(":".join((key, *parts)).encode()).hexdigest()
    return int(hashlib.sha256(f"{key}:{inner}".encode()).hexdigest()[:15], 16)


def feistel(key, tweak, a, b, size_a, size_b):
    for i in range(10):
        if i % 2:
            b = (b + keyed(key, tweak, str(i), str(a))) % size_b
        else:
            a = (a + keyed(key, tweak, str(i), str(b))) % size_a
    return a, b


def digits(key, kind, value):
    u = len(value) // 2
    v = len(value) - u
    a, b = feistel(key, f"{kind}{len(value)}", int(value[:u]), int(value[u:]), 10**u, 10**v)
    return f"{a:0{u}d}{b:0{v}d}"


def luhn(value, doubled):
    worth = lambda d, i: sum(divmod(2 * d, 10)) if i % 2 == doubled else d
    return sum(worth(int(c), i) for i, c in enumerate(reversed(value)))


def refill(form, new):
    left = iter(new)
    return "".join(next(left) if c.isascii() and c.isdigit() else c for c in form)


def moved(key, kind, value):
    cut = -(-len(value) // 2)
    halves = [value[:cut], value[cut:]]
    for i in range(10):
        h = hashlib.sha256(":".join((key, kind, str(i), halves[1 - i % 2])).encode()).hexdigest()
        new = []
        for k, c in enumerate(halves[i % 2]):
            by = int(h[k % 31 * 2 : k % 31 * 2 + 2], 16)
            first, size = next(((f, n) for f, n in (("a", 26), ("A", 26), ("0", 10)) if ord(f) <= ord(c) < ord(f) + n), (c, 1))
            new.append(chr((ord(c) - ord(first) + by) % size + ord(first)))
        halves[i % 2] = "".join(new)
    return "".join(halves)


def day(form, value):
    try:
        return datetime.strptime(value, form).date()
    except ValueError:
        return None


def whole_day(key, d, form):
    n = (d - START).days
    if not 0 <= n < DAYS:
        return None
    a, b = feistel(key, "date", n // 5411, n % 5411, 27, 5411)
    return (START + timedelta(a * 5411 + b)).strftime(form)


def pseudonym(key, value):
    kind = next((k for k, p in PATTERNS.items() if regex.search(f"^(?:{p})$", value, regex.A)), None)
    bare = "".join(c for c in value if c.isascii() and c.isdigit())
    if kind == "email":
        name, _, rest = value.partition("@")
        return f"{moved(key, 'email', name)}@{rest}"
    if kind == "phone":
        return refill(value, bare[:-10] + digits(key, "phone", bare[-10:]))
    if kind == "abroad":
        code = regex.match(r"\+\d+[ .\-]", value)[0]
        return code + refill(value[len(code) :], digits(key, "abroad", bare[len(code) - 2 :]))
    if kind == "ip":
        o = [int(x) for x in value.split(".")]
        if max(o) > 255:
            return value
        a, b = feistel(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"
    if kind == "date":
        for form in ("%Y-%m-%d",) if "-" in value else ("%m/%d/%Y",):
            if day(form, value):
                return whole_day(key, day(form, value), form) or value
        d = day("%d/%m/%Y", value)
        if not d or d not in LATE_AT:
            return value
        a, b = feistel(key, "late date", LATE_AT[d] // 9833, LATE_AT[d] % 9833, 9, 9833)
        return LATE[a * 9833 + b].strftime("%d/%m/%Y")
    if kind == "ssn":
        return refill(value, digits(key, "ssn", bare))
    if kind == "card":
        if luhn(bare, 1) % 10:
            return value
        body = digits(key, "card", bare[:-1])
        return refill(value, body + str(-luhn(body, 0) % 10))
    if kind == "secret":
        made = ""
        for i in range(len(value) // 8):
            part = value[8 * i : 8 * i + 8]
            a, b = feistel(key, f"secret{i}", int(part[:4], 16), int(part[4:], 16), 65536, 65536)
            made += f"{a:04X}{b:04X}"
        return made if regex.search("[A-F]", value) else made.lower()
    if kind in ("access_key", "token"):
        return value[:4] + moved(key, kind.partition("_")[0], value[4:])
    if kind == "assigned":
        name = regex.match(r"\w+\s*[=:]\s*", value, regex.A)[0]
        return name + moved(key, "assigned", value[len(name) :])
    return value


def pseudonymised(key, text):
    if text is None:
        return None, 0
    count = 0

    def swap(match):
        nonlocal count
        new = pseudonym(key, match[0])
        count += new != match[0]
        return new

    return ANY.sub(swap, text), count

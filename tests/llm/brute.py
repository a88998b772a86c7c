"""Plain Python versions of operators, written from their contracts, and rows that are hard to handle."""

import datetime
import hashlib
import re
import zlib

import regex

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\v\f\r"
#: Columns whose names the operators use themselves.
CLASHING = ("doc", "words", "keys", "row", "kept", "key", "n", "digest", "gone_doc", "bad_doc", "lost_doc", "found", "spans", "items", "band", "component", "score")


def lower_az(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_az(text or ""))


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


def keep_lines(rows, min_docs=3, min_chars=20):
    """rows: (doc_id, text). The lines that stay of each, and how many go: {doc_id: (lines, n_dropped)}."""
    key = lambda line: lower_az(line.strip(SPACE))
    holders = {}
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders.setdefault(k, set()).add(doc)
    out = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(h := holders.get(key(x), ())) < min_docs or max(h) == doc]
        out[doc] = stay, len(lines) - len(stay)
    return out


def shingles(text, size=5):
    w = words(text)
    return frozenset(tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, min(len(w), 1))))


def near_classes(rows, similarity=0.8):
    """rows: (doc_id, text). {doc_id: (class_id, n_links)} from all pairs."""
    sets = {doc: shingles(text) for doc, text in rows}
    parent, links = {d: d for d in sets}, dict.fromkeys(sets, 0)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) >= similarity * max(len(x), len(y)) - 1e-9:
                common = len(x & y)
                if common * 10 >= similarity * 10 * (len(x) + len(y) - common) - 1e-9:
                    links[a] += 1
                    links[b] += 1
                    a_root, b_root = sorted((root(a), root(b)))
                    parent[b_root] = a_root
    return {d: (root(d), links[d]) for d in docs}


def contamination(text, items, window=13):
    """items: (item_id, text). n_words, n_hit, items that occur, whether the text counts as contaminated."""
    w = words(text)
    hit, found = set(), set()
    for name, item in items:
        v = words(item)
        size = min(len(v), window)
        known = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if size else set()
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in known:
                found.add(name)
                hit.update(range(i, i + size))
    return len(w), len(hit), sorted(map(str, found)), bool(hit) and 20 * len(hit) >= len(w)


def token_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check_packing(rows, pieces, tokenizer, most=2048):
    """rows: (doc_id, text) with distinct ids. Each id of each document lies in one piece, sequences have no gap."""
    import numpy as np

    ids = {doc: np.array(token_ids(tokenizer, text), "<u4") for doc, text in rows}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        own = ids[p["doc_id"]]
        assert p["doc_tokens"] == len(own) and p["length"] > 0
        assert p["ids_crc32"] == zlib.crc32(own[p["start"] : p["start"] + p["length"]].tobytes())
    assert set(by_doc) == set(ids)
    for doc, spans in by_doc.items():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == len(ids[doc])
    padding = total = 0
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= most
        total += at
        padding += 0 if at & (at - 1) == 0 else most - at
    return padding / max(total, 1)


class Pseudonyms:
    """Pseudonyms of one text at a time: each kind's values as numbers, through ten rounds of keyed addition."""

    def __init__(self, patterns, key, first_day="1800-01-01", days=(189, 773)):
        self.patterns, self.key, self.first, self.days = patterns, key, datetime.date.fromisoformat(first_day), days
        self.any = regex.compile("|".join([*(p for k, p in patterns.items() if k != "email"), patterns["email"]]))

    def digest(self, *parts):
        return hashlib.sha256("|".join(map(str, (self.key, *parts))).encode()).hexdigest()

    def pair(self, name, left, right, a, b):
        for i in range(10):
            shift = int(self.digest(name, a, b, i, left if i % 2 else right)[:15], 16)
            left, right = (left, (right + shift) % b) if i % 2 else ((left + shift) % a, right)
        return left, right

    def digits(self, name, text):
        u = len(text) // 2
        v = len(text) - u
        left, right = self.pair(name, int(text[:u]), int(text[u:]), 10**u, 10**v)
        return f"{left:0{u}}{right:0{v}}"

    @staticmethod
    def luhn(text):
        return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(text)))

    @staticmethod
    def formed(value, digits):
        it = iter(digits)
        return "".join(next(it) if c in "0123456789" else c for c in value)

    def card(self, value):
        own = [c for c in value if c in "0123456789"]
        if self.luhn(own) % 10:
            return None
        body = self.digits("card", "".join(own[:-1]))
        return self.formed(value, body + next(c for c in "0123456789" if self.luhn(body + c) % 10 == 0))

    def phone(self, value):
        own = "".join(c for c in value if c in "0123456789")
        if not 7 <= len(own) <= 15:
            return None
        country = 0 if value[0] != "+" else 1 if own[0] in "17" else 2
        return self.formed(value, own[:country] + self.digits("phone", own[country:]))

    def ssn(self, value):
        a, b, c = map(int, value.split("-"))
        if not 0 < a < 900 or a == 666 or not b or not c:
            return None
        areas = [x for x in range(1, 900) if x != 666]
        left, right = self.pair("ssn", areas.index(a), (b - 1) * 9999 + c - 1, 898, 99 * 9999)
        return f"{areas[left]:03}-{right // 9999 + 1:02}-{right % 9999 + 1:04}"

    def ip(self, value):
        a, b, c, d = map(int, value.split("."))
        if max(a, b, c, d) > 255:
            return None
        left, right = self.pair("ip", a * 256 + b, c * 256 + d, 65536, 65536)
        return ".".join(map(str, (*divmod(left, 256), *divmod(right, 256))))

    def date(self, value):
        mark = next(c for c in value if c in "-/.")
        parts = value.split(mark)
        order = "ymd" if len(parts[0]) == 4 else "mdy" if mark == "/" and int(parts[0]) <= 12 else "dmy"
        at = dict(zip(order, parts, strict=True))
        try:
            place = (datetime.date(*(int(at[x]) for x in "ymd")) - self.first).days
        except ValueError:
            return None
        if not 0 <= place < self.days[0] * self.days[1]:
            return None
        while True:
            left, right = self.pair("date", *divmod(place, self.days[1]), *self.days)
            place = left * self.days[1] + right
            new = self.first + datetime.timedelta(days=place)
            if order != "dmy" or mark != "/" or new.day > 12:
                break
        made = {"y": str(new.year), "m": f"{new.month:0{len(at['m'])}}", "d": f"{new.day:0{len(at['d'])}}"}
        return mark.join(made[x] for x in order)

    def email(self, value):
        low = value.lower()
        domain = low.split("@")[1]
        return f"u{self.digest('name', low)[:16]}@d{self.digest('domain', domain)[:10]}.{domain.split('.')[-1]}"

    def __call__(self, text):
        found = []

        def new(match):
            value = match[0]
            kind = next(k for k, p in self.patterns.items() if regex.fullmatch(p, value))
            made = getattr(self, kind)(value)
            found.extend([kind] * (made is not None))
            return value if made is None else made

        return None if text is None else self.any.sub(new, text), found


def documents(spark, *rows, extra=True):
    """rows: (doc_id, text). A documents table, with columns that clash with names used inside."""
    more = [f"{c} string" for c in CLASHING] if extra else []
    data = [(d, t, "en", "web", len(t or ""), *["x"] * len(more)) for d, t in rows]
    return spark.createDataFrame(data, ", ".join(["doc_id bigint, text string, lang string, source string, n_chars bigint", *more]))


LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(40_000))
#: Null and empty texts, white space, a very long text twice, equal rows, one word, line breaks alone, marks beyond ASCII.
HARD = [(1, None), (2, ""), (3, " \t\n "), (4, LONG), (5, LONG), (6, "one"), (7, "\n\n\n"), (8, "Ünïcödé straße \U0001f600 text"), (9, "one"), (10, "12345 !!!")]

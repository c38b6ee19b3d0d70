"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base detectors (e-mail, IP, card, phone) find what fixed formats prove. Beside them high-recall generators
propose overlapping candidates (written-out addresses, digit groups, colon groups, account codes), at every start
and with every end that their format allows. Boosted trees score each from its format and the words around it, and a
calibrated threshold per generator selects those to redact: all that reach it, also where they overlap each other or
reach beyond a base span; only those that a base span holds whole are left to it. Candidates stay in their document's
row as an array of structs, so scoring needs no shuffle.

The trees are trained here, on labelled candidates that `examples` draws from templates (the tables have no
labels for personal data): true ones in telling contexts, look-alikes in others.

Defined results: null text counts as empty (and stays null when redacted); repeated rows get equal results; an empty table
gives an empty result; columns of the input other than the text stay as they are in `redact`, whatever their names; very long
texts are searched whole. The generators' lengths are limits of the formats: local parts of 64, host labels of 63, numbers of
7 to 19 digits, IBANs of up to 34 characters. Positions are code points.
"""

from __future__ import annotations

import json
import math
import random
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, numbered

#: In the order in which results list them.
KINDS = ("email", "ip", "card", "phone", "contact", "number", "address", "account")

# Fixed formats of the base kinds. Possessive quantifiers and the look-behind change no match; they keep
# long runs linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_VALID = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"

#: Generators of candidates: kind -> what stands before, the format, what stands after, a cheap test that must hold for
#: any match, and where in a match a shorter one may end (None: nowhere).
GENERATORS = {
    "contact": (r"(?<![A-Za-z0-9._%+-])", r"[A-Za-z0-9._%+-]{1,64}+ ?[\[({<]? ?(?:at|AT|@) ?[\])}>]? ?[A-Za-z0-9-]{1,63}(?: ?[\[({<]? ?(?:dot|DOT|\.) ?[\])}>]? ?[A-Za-z0-9-]{2,63}){1,4}", "", r"(?:at|AT|@) ?[\])}>]? ?[A-Za-z0-9-]{1,63} ?[\[({<]? ?(?:dot|DOT|\.)", r"(?<=[A-Za-z0-9-])(?=[^A-Za-z0-9-])"),
    "number": (r"(?<![0-9A-Za-z])", r"[0-9](?:[ ().-]{0,2}+[0-9]){6,18}", r"(?![0-9A-Za-z])", r"[0-9][ ().-]{0,2}[0-9][ ().-]{0,2}[0-9]", r"(?<=[0-9])(?=[^0-9])"),
    "address": (r"(?<![0-9A-Za-z:])", r"(?:[0-9A-Fa-f]{1,4}+:){3,7}+[0-9A-Fa-f]{1,4}+", r"(?![0-9A-Za-z:])", r":[0-9A-Fa-f]{1,4}:", None),
    "account": (r"(?<![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}", r"(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", r"(?<=[A-Z0-9])(?= )"),
}
LEFT, RIGHT = 28, 14

# Words that tell: fixed lists, four languages.
PHONE_WORDS = r"(?i)(?:tel|phone|call|fax|mobil|whatsapp|telefon|teléfono|anruf|appel|portable|sms)"
CARD_WORDS = r"(?i)(?:card|visa|master|amex|credit|karte|carte|tarjeta)"
ID_WORDS = r"(?i)(?:ssn|social|passport|passeport|pasaporte|dni|ausweis|tax id|steuer|iban|account|konto|compte|cuenta)"
MAIL_WORDS = r"(?i)(?:mail|contact|write|reach|kontakt|correo|courriel|schreib)"
OTHER_WORDS = r"(?i)(?:order|invoice|version|isbn|page|sku|build|serial|total|date|ref|article|part|model|figure|population|rev|hash|mac|time)"


def scanned(values: Column, neutral: int, combine) -> Column:
    """Exclusive prefix results of combine (sum, greatest, least) over an array of ints, by blocks so that long arrays
    aren't copied for each element."""
    block = 64
    zero = F.struct(F.lit(neutral).alias("t"), F.array().cast("array<int>").alias("c"))
    add = lambda a, x: F.struct(combine(a["t"], x).alias("t"), F.concat(a["c"], F.array(a["t"])).alias("c"))

    def joined(blocks: Column) -> Column:
        offsets = F.aggregate(F.transform(blocks, lambda b: b["t"]), zero, add)["c"]
        return F.flatten(F.zip_with(blocks, offsets, lambda b, o: F.transform(b["c"], lambda x: combine(x, o))))

    def blocked(a: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(a) / block).cast("int") - 1, F.lit(0))), lambda b: F.aggregate(F.slice(a, b * block + 1, F.lit(block)), zero, add))

    return let(let(values, blocked), joined)


def cumulated(lengths: Column) -> Column:
    return scanned(lengths, 0, lambda x, y: x + y)


def located(text: Column, pattern: str) -> Column:
    """Matches as structs: s, e (code points, end exclusive), t (text), l, r (what stands around)."""

    def placed(x: Column) -> Column:
        m, g = x["m"], x["g"]
        starts = cumulated(F.transform(m, lambda t, i: F.length(F.get(g, i)) + F.length(t)))

        def one(t: Column, i: Column, begin: Column) -> Column:
            s = F.get(begin, i) + F.length(F.get(g, i))
            left, right = F.get(g, i), F.get(g, i + 1)
            return F.struct(s.alias("s"), (s + F.length(t)).alias("e"), t.alias("t"), F.substring(left, -LEFT, LEFT).alias("l"), F.substring(right, 1, RIGHT).alias("r"))

        return let(starts, lambda begin: F.transform(m, lambda t, i: one(t, i, begin)))

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g")), placed)


#: Code points of the blocks that texts are cut into, so that a piece is taken from near its place.
PAGE = 1024


def paged(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))


def between(pages: Column, start: Column, end: Column) -> Column:
    """The text from start to end, from its pages."""
    i, j = (F.floor(x / PAGE).cast("int") for x in (start, end))
    first, last = (lambda x: F.coalesce(F.get(pages, x), F.lit("")))(i), (lambda x: F.coalesce(F.get(pages, x), F.lit("")))(j)
    across = F.concat(F.substring(first, start % PAGE + 1, F.lit(PAGE)), F.array_join(F.slice(pages, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(last, F.lit(1), end % PAGE))
    return F.when(i == j, F.substring(first, start % PAGE + 1, end - start)).otherwise(across)


def proposed(text: Column, kind: str, good) -> Column:
    """The candidates that are good, as structs s, e. One may start inside another, and each has all its ends."""
    before, form, after, _, stop = GENERATORS[kind]
    start = f"{before}(?=({form}){after})"
    marked = F.concat(F.lit("\n"), text)  # split drops what is before a match without length at 0

    def ends(t: Column) -> Column:
        if stop is None:
            return F.array(t)
        return let(F.split(t, stop, -1), lambda p: F.filter(F.transform(F.sequence(F.lit(1), F.size(p)), lambda j: F.array_join(F.slice(p, 1, j), "")), lambda u: u.rlike(f"^(?:{form})$")))

    def placed(x: Column) -> Column:
        def one(t: Column, s: Column) -> Column:
            left = between(x["pages"], F.greatest(s - LEFT, F.lit(0)), s)
            around = lambda e: between(x["pages"], e, F.least(e + RIGHT, x["n"]))
            every = F.transform(ends(t), lambda u: F.struct(s.alias("s"), (s + F.length(u)).alias("e"), u.alias("t")))
            full = let(left, lambda l: F.transform(every, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["t"].alias("t"), l.alias("l"), around(c["e"]).alias("r"))))
            return F.transform(F.filter(full, good), lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e")))

        return F.flatten(F.transform(x["m"], lambda t, i: let(F.get(x["starts"], i + 1) - 1, lambda s: one(t, s))))

    def pieced(m: Column) -> Column:
        starts = cumulated(F.transform(F.split(marked, start, -1), F.length))
        return F.when(F.size(m) == 0, F.array().cast("array<struct<s:int,e:int>>")).otherwise(let(F.struct(m.alias("m"), starts.alias("starts"), paged(text).alias("pages"), F.length(text).alias("n")), placed))

    return let(F.regexp_extract_all(marked, F.lit(start), F.lit(1)), pieced)


NONE = "array<struct<s:int,e:int,t:string,l:string,r:string>>"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    return F.call_function("luhn_check", number)


def valid(kind: str, t: Column) -> Column:
    if kind == "ip":
        return t.rlike(IP_VALID)
    if kind == "card":
        return let(F.translate(t, " -", ""), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits(t)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    none = F.array().cast(NONE)
    hint = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"), "phone": F.contains(text, F.lit("+"))}
    matches = lambda kind, pattern: F.when(hint[kind], F.filter(located(text, pattern), lambda x: valid(kind, x["t"]))).otherwise(none)
    return {kind: matches(kind, pattern) for kind, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))}


def features(kind: str, c: Column) -> dict[str, Column]:
    """Whole numbers that describe a candidate's format and context."""
    t, left, right = c["t"], c["l"], c["r"]
    has = lambda where, pattern: where.rlike(pattern).cast("int")
    around = F.concat_ws(" ", left, right)
    n = F.length(digits(t))
    return {
        "kind": F.lit(KINDS.index(kind)), "digits": n, "length": F.length(t), "seps": F.length(F.regexp_replace(t, r"[^ ().-]", "")),
        "luhn": F.when(n > 0, luhn(digits(t))).otherwise(False).cast("int"), "phone_shape": has(t, r"^\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$"),
        "id_shape": has(t, r"^[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}$"), "date_shape": has(t, r"^(?:19|20)[0-9]{2}[ .-][0-9]{2}[ .-][0-9]{2}"), "quads": has(t, r"^[0-9]{4}(?:[ -][0-9]{3,6}){2,4}$"),
        "words_at": has(t, r"(?i)[^a-z]at[^a-z].*[^a-z]dot[^a-z]|[\[({<] ?at|@"), "dots": F.length(t) - F.length(F.translate(t, ".", "")), "tld": has(t, r"(?i)(?:com|net|org|edu|gov|info|de|fr|es|uk|io)$"),
        "phone_word": has(around, PHONE_WORDS), "card_word": has(around, CARD_WORDS), "id_word": has(around, ID_WORDS), "mail_word": has(around, MAIL_WORDS), "other_word": has(around, OTHER_WORDS),
        "sign_before": has(left, r"[#$€£§=/._-] ?$"), "plus_before": has(left, r"\+ ?$"), "unit_after": has(right, r"^ ?(?:%|[A-Za-z]{1,2}\b|[€$£/._=-])"), "hexes": has(t, r"[A-Fa-f]"), "groups": F.size(F.split(t, r"[^0-9A-Za-z]+")),
    }


NAMES = ("kind", "digits", "length", "seps", "luhn", "phone_shape", "id_shape", "date_shape", "quads", "words_at", "dots", "tld", "phone_word", "card_word", "id_word", "mail_word", "other_word", "sign_before", "plus_before", "unit_after", "hexes", "groups")


def examples(n: int = 2400, seed: int = 11) -> list[dict]:
    """Labelled candidates drawn from templates: text, its contexts, its generator, and 1 if personal."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(rng.randint(1, 4))) + " "
    tel, ids, card, mail = ("tel: ", "phone ", "call me on ", "fax ", "mobile: ", "Telefon "), ("SSN ", "passport no ", "social security: ", "tax id ", "DNI "), ("card ", "visa ", "credit card: ", "amex "), ("mail me: ", "contact ", "write to ", "reach me at ")
    other = ("order ", "invoice ", "version ", "isbn ", "page ", "SKU ", "serial ", "total ", "ref. ", "part no ", "date ")
    three = lambda s: f"{num(3)}{s}{num(3)}{s}{num(4)}"
    def checked(k: int) -> str:
        body = num(k - 1)
        return next(body + c for c in "0123456789" if sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(body + c))) % 10 == 0)

    out = []
    for i in range(n):
        personal = i % 2
        kind = rng.choice(("contact", "number", "number", "number", "address", "account"))
        before = prose()
        if kind == "contact":
            host = f"{word()}{rng.choice((' dot ', ' [dot] ', '(dot)', '.'))}{rng.choice(('com', 'net', 'org', 'de', 'fr'))}"
            t = f"{word()}{rng.choice((' at ', ' [at] ', '(at)', ' (at) ', ' @ '))}{host}" if personal else f"{word()} at {word()}{rng.choice(('. ', '.'))}{word()}"
            before = rng.choice((prose(), rng.choice(mail))) if personal else before
        elif kind == "address":
            t = ":".join(rng.choice(("fe80", "2001", "0db8", f"{rng.randrange(65536):x}")) for _ in range(8)) if personal else ":".join(num(2) for _ in range(rng.choice((4, 5, 6))))
            before = before if personal else rng.choice((before, "time ", "MAC "))
        elif kind == "account":
            t = f"{rng.choice(('DE', 'FR', 'ES', 'GB'))}{num(2)} {' '.join(num(4) for _ in range(rng.randint(3, 5)))}" if personal else f"{rng.choice(('AB', 'XK', 'PN', 'QT'))}{num(2)}{''.join(rng.choice('ABCDEFGHJK') for _ in range(12))}"
            before = rng.choice(("IBAN ", "account: ", prose())) if personal else rng.choice((prose(), *other))
        elif personal:
            shape = rng.randrange(5)
            t = (three(rng.choice("-. ")), f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(2)}-{num(4)}", checked(rng.choice((15, 15, 16, 16, 14, 19))), num(10))[shape]
            before = rng.choice((prose(), rng.choice(tel))) if shape < 2 else rng.choice(ids) if shape == 2 else rng.choice((prose(), *card)) if shape == 3 else rng.choice(tel)
        else:
            t = (num(8), num(rng.choice((7, 9, 12, 16, 16, 16, 15, 19))), f"{rng.choice(('1999', '2024'))}-{num(2)}-{num(2)} {num(2)}", f"{num(3)}.{num(3)}.{num(2)}", f"{num(3)} {num(3)} {num(3)}", f"{num(1)}-{num(3)}-{num(5)}-{num(1)}", three("-"))[rng.randrange(7)]
            before = rng.choice(other) if t[3:4] == t[7:8] == "-" else rng.choice((prose(), *other, "#", "$"))
        out.append({"g": kind, "t": t, "l": (prose() + before)[-LEFT:], "r": (rng.choice((" ", ". ", ", ")) + prose())[:RIGHT], "y": personal})
    return out


def boosted(rows: list[tuple[tuple[int, ...], int, int]], rounds: int = 40, rate: float = 0.3) -> tuple[float, list]:
    """Trees of depth two for logistic loss by Newton steps. rows: features, positives, count."""
    total, ones = sum(c for _, _, c in rows), sum(p for _, p, _ in rows)
    bias = math.log((ones + 1) / (total - ones + 1))
    f, trees = [bias] * len(rows), []
    cuts = [(j, c) for j in range(len(rows[0][0])) for c in sorted({x[j] for x, _, _ in rows})[:-1]]
    cuts = [(j, c) for j in range(len(rows[0][0])) if (own := [c for k, c in cuts if k == j]) for c in own[:: max(1, len(own) // 8)]]

    def split(at: list[int], g: list[float], h: list[float]):
        sg, sh = sum(g[i] for i in at), sum(h[i] for i in at)
        best = (sg * sg / (sh + 1), None, at, [])
        for j, c in cuts:
            lg = lh = 0.0
            for i in at:
                if rows[i][0][j] <= c:
                    lg += g[i]
                    lh += h[i]
            gain = lg * lg / (lh + 1) + (sg - lg) ** 2 / (sh - lh + 1)
            if gain > best[0] + 1e-9:
                best = (gain, (j, c), None, None)
        if best[1] is None:
            return None, at, []
        j, c = best[1]
        return best[1], [i for i in at if rows[i][0][j] <= c], [i for i in at if rows[i][0][j] > c]

    def leaf(at: list[int], g: list[float], h: list[float]) -> float:
        value = rate * sum(g[i] for i in at) / (sum(h[i] for i in at) + 1)
        for i in at:
            f[i] += value
        return value

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-v)) for v in f]
        g = [y - c * q for (_, y, c), q in zip(rows, p, strict=True)]
        h = [c * q * (1 - q) for (_, _, c), q in zip(rows, p, strict=True)]
        top, low, high = split(list(range(len(rows))), g, h)
        if top is None:
            break
        sides = []
        for side in (low, high):
            cut_at, a, b = split(side, g, h)
            sides.append((cut_at, leaf(a, g, h), leaf(b, g, h) if b else 0.0))
        trees.append((top, sides))
    return bias, trees


def predicted(model: tuple[float, list], x: tuple[int, ...]) -> float:
    f = model[0]
    for (j, c), sides in model[1]:
        cut_at, a, b = sides[0 if x[j] <= c else 1]
        f += a if cut_at is None or x[cut_at[0]] <= cut_at[1] else b
    return 1 / (1 + math.exp(-f))


def score(model: tuple[float, list], x: Column) -> Column:
    """The trees as one expression over a struct of features."""
    f = F.lit(model[0])
    for (j, c), sides in model[1]:
        leaves = [F.lit(a) if cut_at is None else F.when(x[NAMES[cut_at[0]]] <= cut_at[1], a).otherwise(b) for cut_at, a, b in sides]
        f = f + F.when(x[NAMES[j]] <= c, leaves[0]).otherwise(leaves[1])
    return 1 / (1 + F.exp(-f))


@lru_cache(maxsize=4)
def trained(spark, n: int = 2400, precision: float = 0.98):
    """The trees, and per generator the lowest threshold that reaches the precision on held-out examples.

    Examples get their features by the same expressions as documents; n rows come to the driver."""
    rows = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(examples(n))), "array<struct<g:string,t:string,l:string,r:string,y:int>>")))
    c = F.struct("t", "l", "r")
    found = []
    for kind in GENERATORS:
        x = features(kind, c)
        found += [(kind, tuple(r[k] for k in NAMES), r["y"]) for r in rows.where(F.col("g") == kind).select("y", *[x[k].alias(k) for k in NAMES]).collect()]
    counts: dict[tuple[int, ...], list[int]] = {}
    for i, (_, x, y) in enumerate(found):
        if i % 3:
            own = counts.setdefault(x, [0, 0])
            own[0] += y
            own[1] += 1
    model = boosted([(x, p, k) for x, (p, k) in counts.items()])
    thresholds = {}
    for kind in GENERATORS:
        held = sorted(((predicted(model, x), y) for i, (k, x, y) in enumerate(found) if k == kind and i % 3 == 0), reverse=True)
        thresholds[kind], hits = 1.0, 0
        for i, (p, y) in enumerate(held):
            hits += y
            if hits / (i + 1) >= precision and (i + 1 == len(held) or held[i + 1][0] < p):
                thresholds[kind] = max(p, 0.5)
    return model, thresholds


SPAN = "array<struct<k:int,s:int,e:int>>"
FAR = 2**31 - 1


def free_of(picked: Column, base: Column, whole: bool = False) -> Column:
    """The picked spans that overlap no base span; with whole, those that no base span holds whole. All spans are sorted
    by start, base ones first: a span overlaps an earlier one where the greatest base end so far is beyond its start (is
    in it where that end isn't before its own), and a later one where the next base start is before its end."""
    tagged = lambda spans, own: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(not own).alias("picked"), x["e"].alias("e"), x["k"].alias("k")))

    def kept(every: Column) -> Column:
        ends = scanned(F.transform(every, lambda x: F.when(x["picked"], 0).otherwise(x["e"])), 0, F.greatest)
        if whole:
            seen = let(ends, lambda b: F.filter(every, lambda x, i: x["picked"] & (F.get(b, i) < x["e"])))
        else:
            starts = F.reverse(scanned(F.reverse(F.transform(every, lambda x: F.when(x["picked"], FAR).otherwise(x["s"]))), FAR, F.least))
            seen = let(F.struct(ends.alias("ends"), starts.alias("starts")), lambda b: F.filter(every, lambda x, i: x["picked"] & (F.get(b["ends"], i) <= x["s"]) & (F.get(b["starts"], i) >= x["e"])))
        return F.sort_array(F.transform(seen, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))))

    return F.when((F.size(picked) == 0) | (F.size(base) == 0), picked).otherwise(let(F.sort_array(F.concat(tagged(base, True), tagged(picked, False))), kept))


def found_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _base and _added: arrays of structs k (kind's number), s, e, sorted by kind and start."""
    t = F.coalesce(F.col(text), F.lit(""))
    model, thresholds = trained(docs.sparkSession)
    base = base_spans(t)
    plain = lambda kind, spans: F.transform(spans, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    docs = docs.withColumn("_base", F.concat(*[plain(k, v) for k, v in base.items()]))

    def selected(kind: str) -> Column:
        def good(c: Column) -> Column:
            x = F.struct(*[v.alias(k) for k, v in features(kind, c).items()])
            return let(x, lambda v: score(model, v)) >= thresholds[kind]

        return F.when(t.rlike(GENERATORS[kind][3]), plain(kind, proposed(t, kind, good))).otherwise(F.array().cast(SPAN))

    docs = docs.withColumn("_picked", F.concat(*[selected(kind) for kind in GENERATORS]))
    return docs.withColumn("_added", free_of(F.col("_picked"), F.col("_base"), whole=True)).drop("_picked")


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def detect(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, their digest, and all spans."""
    found = found_spans(docs.select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("_base", lambda x: x["k"] == KINDS.index(kind))).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[n(k) for k in KINDS[:4]], F.sha2(joined(F.col("_base")).cast("binary"), 256).alias("base_sha256"), joined(F.concat("_base", "_added")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span in the text replaced by its kind in brackets; overlapping spans become one, of the first's kind.
    The work is linear in the text and n log n in its spans."""
    kept = docs.columns
    docs, text = numbered(docs), f"c{kept.index(text)}"
    t = F.col(text)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    by_start = F.sort_array(F.transform(F.concat("_base", "_added"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))

    def replaced(spans: Column) -> Column:
        reach = scanned(F.transform(spans, lambda x: x["e"]), 0, F.greatest)  # where all spans before end
        heads = let(reach, lambda r: F.filter(F.transform(spans, lambda x, i: F.struct(F.get(r, i).alias("m"), x["s"].alias("s"), x["k"].alias("k"))), lambda h: h["s"] >= h["m"]))

        def pieces(p: Column) -> Column:
            end = F.array_max(F.transform(spans, lambda x: x["e"]))
            return F.concat(F.array_join(F.transform(heads, lambda h: F.concat(between(p, h["m"], h["s"]), F.get(names, h["k"]))), ""), between(p, end, F.length(t)))

        return let(paged(t), pieces)

    whole = F.when(F.size("_base") + F.size("_added") == 0, t).otherwise(let(by_start, replaced))
    return found_spans(docs, text).withColumn("_text", whole).select(*[F.col("_text" if c == text else c).alias(name) for c, name in zip(docs.columns, kept, strict=True)])

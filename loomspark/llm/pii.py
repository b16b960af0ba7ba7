"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base spans come from exact patterns and always stay. On top, loose generators propose further spans of the
same kinds (obfuscated addresses, local phone numbers, IPv6, cards of 13 digits or with other separators),
which may overlap one another and the base. Boosted trees score each proposal by its format and the words
around it; per kind, a threshold calibrated on held-back examples selects. Proposals that overlap a base
span, or a better proposal of any kind, give way; of equals, the earlier one stays, then the kind listed first.

Trees are trained on proposals that the same SQL makes: in cases written by rule (EXAMPLES of each), in all e-mail addresses
of all documents, rewritten in the loose forms between their own words (they are surely personal data), and in all documents
as they are, which counts as not personal, as loose forms are rare in running text. Equal proposals of a text count once.
Those of documents are counted by their features, so what the driver gets is bounded by the kinds of proposals, not by their number;
where there are more than VECTORS of them, large numbers are counted in coarser steps. However many there are, either kind weighs
no more than PROPOSALS cases. A held-back share of all three calibrates the thresholds.

All positions are code points, end exclusive. Null text is empty: no spans. Everything happens in the row
that holds the text: no shuffle, no explode, and time grows with the length and the spans of a text, not with their
square. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trees
from ._common import discard, materialise, release, small

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive groups match what the plain ones do and keep long runs linear; an address
#: starts where a run of its characters starts, or where the last match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text (in `_t`) must hold for the pattern to be worth trying: all that the pattern matches holds it.
NEEDS = {"email": "instr(_t, '@') > 0", "ip": r"_t RLIKE '[0-9]\\.[0-9]'", "card": "_t RLIKE '[0-9][ -]?[0-9]'", "phone": "instr(_t, '+') > 0"}
#: The loose generators.
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\s?(?:@|\(at\)|\[at\]|\{at\}| at )\s?[a-z0-9-]++(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\}| dot )\s?[a-z0-9-]++)++",
    "ip": r"(?i)(?<![0-9a-f:])(?:(?:[0-9a-f]{1,4}:){3,7}(?::?[0-9a-f]{1,4})?(?![0-9a-f:])|(?<![g-z_])(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6}+)?::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6}+)?(?![0-9a-z_:]))",
    "card": r"(?<![0-9])[0-9]{4}(?:[ ._-]?[0-9]{2,7}){2,4}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\(?0{0,2}[1-9][0-9]{0,2}\)?[ ./-])?\(?[0-9]{2,5}\)?[ ./-][0-9]{3,4}[ ./-]?[0-9]{3,4}(?![0-9])",
}
LOOSE_NEEDS = {
    "email": r"_t RLIKE '(?i)@|[(\\[{]at[)\\]}]| at \\s?[a-z0-9-]+\\s?(?:[.]|[(\\[{]dot[)\\]}]| dot )'",
    "ip": r"_t RLIKE '(?i)[0-9a-f]:[0-9a-f]{1,4}:|::'",
    "card": r"_t RLIKE '[0-9]{4}[ ._-]?[0-9]'",
    "phone": r"_t RLIKE '[0-9][) ./-]{1,2}[0-9]{3}'",
}
STEP = 256


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, rest: str) -> str:
    """A local variable in SQL: a lambda over an array of one."""
    return f"transform(array({value}), {name} -> {rest})[0]"


def spans(t: str, pattern: str, context: bool = False) -> str:
    """SQL for array<struct<s int, e int, v string>>: matches of the pattern with their code points.

    Matches are fenced by two characters that the text doesn't hold, the text is cut at the fences, and
    lengths are summed in blocks of STEP parts, so that many matches don't cost the square of their number.
    With context, `b` holds up to 32 characters since the match before, `a` the character after.
    """
    parts = f"split(regexp_replace({t}, {_quote(pattern)}, '\ue000$0\ue001'), '[\ue000\ue001]')"
    lens = "transform(p, x -> char_length(x))"
    blocks = f"sequence(0, CAST((size(p) - 1) div {STEP} AS INT))"
    sums = f"transform({blocks}, c -> aggregate(slice(n, c * {STEP} + 1, {STEP}), 0, (a, x) -> a + x))"
    offs = "transform(sequence(0, size(m) - 1), c -> aggregate(slice(m, 1, c), 0, (a, x) -> a + x))"
    inner = f"filter(sequence(c * {STEP}, least(size(p) - 1, (c + 1) * {STEP} - 1)), i -> i % 2 = 1)"
    start = f"o[c] + aggregate(slice(n, c * {STEP} + 1, i - c * {STEP}), 0, (a, x) -> a + x)"
    around = ", 'b', right(p[i - 1], 32), 'a', left(p[i + 1], 1)" if context else ""
    one = f"named_struct('s', {start}, 'e', {start} + n[i], 'v', p[i]{around})"
    body = f"flatten(transform({blocks}, c -> transform({inner}, i -> {one})))"
    return let("p", parts, let("n", lens, let("m", sums, let("o", offs, body))))


def survivors(spans_: str, loser: str) -> str:
    """SQL for the spans (s, e, ...) of an array that lose to none that overlaps them, sorted.

    `loser` is SQL over two overlapping spans, o and x, of which o sorts first: 1 if x loses, 2 if o does, else 0.
    Starts and ends are ranked by sorting, so each span looks at those only that begin inside it: spans of a kind don't
    overlap one another, which makes these few for each place of the text.
    """
    ends = "array_sort(concat(transform(S, q -> named_struct('p', q.s, 't', 1, 'i', -1)), transform(S, (q, n) -> named_struct('p', q.e, 't', 0, 'i', n))))"
    # of each span, how many begin before it ends: the place of its end less the ends before it
    places = f"filter(transform({ends}, (q, n) -> named_struct('i', q.i, 't', q.t, 'n', n)), q -> q.t = 0)"
    begun = f"transform(array_sort(transform({places}, (q, m) -> named_struct('i', q.i, 'h', q.n - m))), q -> q.h)"
    meets = let("o", "S[i]", let("x", "S[j]", f"CASE {loser} WHEN 1 THEN j WHEN 2 THEN i ELSE -1 END"))
    lost = f"flatten(transform(sequence(0, size(S) - 1), i -> CASE WHEN H[i] > i + 1 THEN transform(sequence(i + 1, H[i] - 1), j -> {meets}) ELSE CAST(array() AS array<int>) END))"
    kept = f"transform(array_except(sequence(0, size(S) - 1), {lost}), i -> S[i])"
    return let("S", f"array_sort({spans_})", f"CASE WHEN size(S) < 2 THEN S ELSE {let('H', begun, kept)} END")


NONE = "CAST(array() AS array<struct<s: int, e: int, v: string>>)"
_DIGITS = "regexp_replace(x.v, '[^0-9]', '')"
#: Luhn's sum over the digits d from the right.
_LUHN = "aggregate(sequence(1, char_length({d})), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN CAST(substring({d}, -i, 1) AS INT) ELSE CAST((2 * CAST(substring({d}, -i, 1) AS INT)) div 10 AS INT) + (2 * CAST(substring({d}, -i, 1) AS INT)) % 10 END)"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
VALID = {
    "email": "true",
    "ip": rf"x.v RLIKE '^{_PART}(?:\\.{_PART}){{3}}$'",
    "card": f"char_length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN.format(d=_DIGITS)} % 10 = 0",
    "phone": f"char_length({_DIGITS}) BETWEEN 10 AND 15",
}

#: Words before a span that speak for or against a kind.
CONTEXT = {
    "for_phone": r"(?i)(?:phone|tel|call|mobile|fax|whatsapp|sms|fon|llam|appel)[^\\n]{0,20}$",
    "for_mail": r"(?i)(?:mail|contact|write|reach|kontakt|correo|courriel)[^\\n]{0,20}$",
    "for_card": r"(?i)(?:card|visa|master|amex|credit|debit|karte|carte|tarjeta|payment)[^\\n]{0,20}$",
    "for_ip": r"(?i)(?:\\bip|host|address|server|client|adresse|login)[^\\n]{0,20}$",
    "against": r"(?i)(?:version|release|order|invoice|ref|isbn|issn|section|chapter|page|no|nr|id|serial|sku|part|ratio|score|time|date|since|year|doi|hash|sum|total|\\bv)[^a-z\\n]{0,4}$",
}
FEATURES = ["kind", "length", "digits", "letters", "groups", "longest", "luhn", "dots", "colons", "parens", "at_sign", "at_word", "stops", "tld", "iin", "date_like", "glued", *CONTEXT]


def features() -> str:
    """SQL for a struct of the features of proposal x (k, s, e, v, b, a)."""
    before, around = "x.b", "concat(right(x.b, 1), x.a)"
    parts = {
        "kind": "x.k",
        "length": "char_length(x.v)",
        "digits": f"char_length({_DIGITS})",
        "letters": "char_length(regexp_replace(x.v, '[^A-Za-z]', ''))",
        "groups": "size(regexp_extract_all(x.v, '[0-9]+', 0))",
        "longest": "array_max(concat(array(0), transform(regexp_extract_all(x.v, '[0-9]+', 0), g -> char_length(g))))",
        "luhn": f"CASE WHEN char_length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN.format(d=_DIGITS)} % 10 = 0 THEN 1 ELSE 0 END",
        "dots": "char_length(regexp_replace(x.v, '[^.]', ''))",
        "colons": "char_length(regexp_replace(x.v, '[^:]', ''))",
        "parens": "CASE WHEN x.v RLIKE '[(]' THEN 1 ELSE 0 END",
        "at_sign": "CASE WHEN instr(x.v, '@') > 0 THEN 1 ELSE 0 END",
        "at_word": r"CASE WHEN x.v RLIKE '(?i)[(\\[{]at[)\\]}]' THEN 2 WHEN x.v RLIKE '(?i) at .* dot ' THEN 1 WHEN x.v RLIKE '(?i) at ' THEN 3 ELSE 0 END",
        "stops": r"CASE WHEN x.v RLIKE '[.]\\s' THEN 1 ELSE 0 END",
        "tld": r"CASE WHEN x.v RLIKE '(?i)(?:[.]|dot[)\\]}]?) ?(?:com|org|net|edu|gov|io|de|fr|es|uk|info)$' THEN 1 ELSE 0 END",
        "iin": "CASE WHEN x.v RLIKE '^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|36|30)' THEN 1 ELSE 0 END",
        "date_like": r"CASE WHEN x.v RLIKE '^(?:19|20)[0-9]{2}[ ./-][0-9]{2}[ ./-]' OR x.v RLIKE '[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}$' THEN 1 ELSE 0 END",
        "glued": f"CASE WHEN {around} RLIKE '[A-Za-z0-9_#/=]' THEN 1 ELSE 0 END",
    } | {k: f"CASE WHEN {before} RLIKE '{p}' THEN 1 ELSE 0 END" for k, p in CONTEXT.items()}
    return "named_struct(" + ", ".join(f"'{k}', CAST({v} AS DOUBLE)" for k, v in parts.items()) + ")"


def _clean(text: str) -> Column:
    """The text, null as empty, with the two fences replaced where they occur (lengths stay)."""
    t = f"coalesce({text}, '')"
    return F.expr(f"CASE WHEN instr({t}, '') > 0 OR instr({t}, '') > 0 THEN translate({t}, '', '') ELSE {t} END")


def _with_base(docs: DataFrame, text: str) -> DataFrame:
    """Adds `_t` and `_base`: array<struct<s, k, e, v>> sorted by start, then kind."""
    found = ", ".join(f"transform(filter(CASE WHEN {NEEDS[k]} THEN {spans('_t', BASE[k])} ELSE {NONE} END, x -> {VALID[k]}), x -> named_struct('s', x.s, 'k', {i}, 'e', x.e, 'v', x.v))" for i, k in enumerate(KINDS))
    return docs.withColumn("_t", _clean(text)).withColumn("_base", F.expr(f"array_sort(concat({found}))"))


def _with_proposals(docs: DataFrame) -> DataFrame:
    """Adds `_more`: proposals (k, s, e, v) that overlap no base span, each with its features f."""
    none = "CAST(array() AS array<struct<s: int, e: int, v: string, b: string, a: string>>)"
    found = ", ".join(f"transform(CASE WHEN {LOOSE_NEEDS[k]} THEN {spans('_t', LOOSE[k], True)} ELSE {none} END, x -> named_struct('s', x.s, 'k', {i}, 'e', x.e, 'v', x.v, 'b', x.b, 'a', x.a, 'base', false))" for i, k in enumerate(KINDS))
    base = "transform(_base, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e, 'v', '', 'b', '', 'a', '', 'base', true))"
    free = survivors(f"concat(_more, {base})", "(CASE WHEN o.base AND NOT x.base THEN 1 WHEN x.base AND NOT o.base THEN 2 ELSE 0 END)")
    out = docs.withColumn("_more", F.expr(f"concat({found})"))
    out = out.withColumn("_more", F.expr(f"CASE WHEN size(_base) = 0 OR size(_more) = 0 THEN _more ELSE filter({free}, x -> NOT x.base) END"))
    return out.withColumn("_more", F.expr(f"transform(_more, x -> named_struct('k', x.k, 's', x.s, 'e', x.e, 'v', x.v, 'f', {features()}))"))


#: Labelled examples of each case, the share of them that calibrates the thresholds, and the precision these must reach there.
EXAMPLES, HELD_BACK, PRECISION = 60, 0.3, 0.98
#: Cases that all proposals in documents weigh together at most, and the rewritten addresses; from where on a feature's size makes
#: no difference, and how many feature vectors the driver takes before they are counted more coarsely.
PROPOSALS, CLIP, VECTORS = 3000, 64, 50_000
#: Distinct texts that there must be to tell that what they propose is rare; fewer teach nothing.
ENOUGH = 100
#: Curvature of the loss (a quarter an example at most) that a leaf must have.
LEAF = 2.0


def examples(n: int = EXAMPLES, seed: int = 5) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) of spans written by rule: kinds of personal data and what looks like them."""
    rng = np.random.default_rng(seed)
    d = lambda k: "".join(str(x) for x in rng.integers(0, 10, k))
    w = lambda k: "".join(chr(97 + x) for x in rng.integers(0, 26, k))
    one = lambda *xs: xs[int(rng.integers(len(xs)))]
    h = lambda k: ":".join(f"{int(x):x}" for x in rng.integers(4096, 65536, k))

    def card(k: int) -> str:
        body = one("4", "51", "34", "6011") + d(k)
        body = body[: k - 1]
        total = sum(int(c) if i % 2 else (2 * int(c)) // 10 + (2 * int(c)) % 10 for i, c in enumerate(reversed(body)))
        return body + str(-total % 10)

    out = []
    fill = lambda: " ".join(w(int(rng.integers(2, 9))) for _ in range(int(rng.integers(1, 6))))
    for _ in range(n):
        good = [
            (one("email ", "contact ", "write to ", ""), f"{w(5)}{one(' (at) ', '(at)', ' [at] ', '[at]')}{w(6)}{one(' (dot) ', '[dot]', '.')}{one('com', 'org', 'de')}"),
            (one("email ", "mail: ", "reach me "), f"{w(5)} at {w(6)} dot {one('com', 'net', 'org')}"),
            (one("email ", "mail: ", "write to ", ""), f"{w(5)} at {w(6)}.{one('com', 'net', 'org', 'de')}"),
            (one("ip ", "host ", "server ", ""), one(f"2001:db8::{h(1)}", f"fe80::{h(2)}", f"{h(3)}::{h(1)}", f"{h(2)}::{h(3)}", f"::{d(1)}")),
            (one("phone ", "tel: ", "call ", "mobile "), one(f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(3)} {d(4)} {d(3)}")),
            ("", f"({d(3)}) {d(3)}-{d(4)}"),
            (one("ip ", "host ", "server ", ""), ":".join(f"{int(x):x}" for x in rng.integers(4096, 65536, 8))),
            (one("card ", "visa ", "credit card "), one(".", "_").join((c := card(16))[i : i + 4] for i in range(0, 16, 4))),
            (one("card ", "visa "), card(13)),
        ]
        bad = [
            (one("date ", "since ", ""), f"20{d(2)}-0{one('1', '2', '3')}-1{d(1)} {d(2)}:{d(2)}:{d(2)}"),
            (one("order ", "invoice no ", "id ", "ref "), one(f"{d(3)}-{d(3)}-{d(4)}", f"{d(4)} {d(4)} {d(4)}", d(13))),
            (one("time ", ""), f"{d(2)}:{d(2)}:{d(2)}:{d(2)}"),
            (one("isbn ", "doi ", "part "), f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}"),
            (one("total ", "sum ", ""), f"{d(4)}.{d(4)}.{d(4)}"),
            ("", f"{w(5)} at {w(6)} dot"),
            ("", f"{w(5)} at {w(6)}. {one(w(5), w(2), 'es', 'de')}"),
            ("", f"{w(4)} at {w(6)}.{w(5)}"),
            ("", one("::", "abc::", "::add", "face::", "bad::cafe", "dead::", "c::d")),
            ("", d(16)),
            ("", f"{d(4)} {d(3)} {d(4)}"),
        ]
        for cases, label in ((good, 1), (bad, 0)):
            for lead, v in cases:
                a = f"{fill()} {lead}"
                out.append((f"{a}{v} {fill()}.", len(a), len(a) + len(v), label))
    return out


def _rewritten(addresses: DataFrame) -> DataFrame:
    """(_o, text, _from, _to) of (b, v, a, _o): each address in one of the loose forms, between the words that stood around it."""
    at = "element_at(array(' (at) ', '(at)', ' [at] ', ' at ', ' at ', ' {at} '), CAST(pmod(_o, 6) AS INT) + 1)"
    dot = "element_at(array(' (dot) ', '[dot]', '.', ' dot ', '.', ' {dot} '), CAST(pmod(_o, 6) AS INT) + 1)"
    form = f"concat(substring_index(v, '@', 1), {at}, replace(substring_index(v, '@', -1), '.', {dot}))"
    out = addresses.withColumn("_form", F.expr(form))
    return out.selectExpr("_o", "concat(b, _form, a) AS text", "char_length(b) AS _from", "char_length(b) + char_length(_form) AS _to")


def _counted(rows: DataFrame) -> list[tuple]:
    """(held, label, n, features...) of (_o, label, features...): held back by hash, counted by features."""
    held = (F.pmod(F.xxhash64(F.lit("held"), "_o"), F.lit(1000)) < int(1000 * HELD_BACK)).alias("held")
    keys = ["held", "label", *FEATURES]
    counts = materialise(rows.select(held, "label", *[F.least(F.col(f), F.lit(float(CLIP))).alias(f) for f in FEATURES]).groupBy(*keys).agg(F.count("*").alias("n")), "proposals")
    found, step = counts, 1
    while step < CLIP and found.limit(VECTORS + 1).count() > VECTORS:
        step *= 2
        coarse = [F.when(F.col(f) >= 8, F.floor(F.col(f) / step) * step).otherwise(F.col(f)).cast("double").alias(f) for f in FEATURES]
        found = counts.select("held", "label", *coarse, "n").groupBy(*keys).agg(F.sum("n").alias("n"))
    out = sorted(tuple(r) for r in found.select("held", "label", "n", *FEATURES).collect())
    discard(counts)
    release(rows.sparkSession)
    return out


def _from_documents(docs: DataFrame, text: str) -> tuple[list, list]:
    """Of all documents, counted by features: what the generators propose, and what they propose for rewritten e-mail addresses."""
    texts = docs.select(F.col(text).alias("x")).where("x IS NOT NULL").withColumn("h", F.xxhash64("x"))
    if texts.select("h").distinct().limit(ENOUGH).count() < ENOUGH:
        return [], []
    made = _with_proposals(_with_base(texts, "x"))
    rows = made.select("h", F.explode("_more").alias("x")).select(F.xxhash64("h", "x.s", "x.k").alias("_o"), F.lit(0).alias("label"), *[f"x.f.{f}" for f in FEATURES])
    address = F.expr(f"transform({spans('_t', BASE['email'], True)}, x -> struct(x.b, x.v, x.a, x.s))")
    mails = texts.withColumn("_t", _clean("x")).where(NEEDS["email"]).select("h", F.explode(address).alias("x")).select("x.b", "x.v", "x.a", F.xxhash64("h", "x.s").alias("_o"))
    found = _with_proposals(_with_base(_rewritten(mails.dropDuplicates(["_o"])), "text")).select("_o", "_from", "_to", F.explode("_more").alias("x"))
    loose = found.select("_o", F.expr("CAST(x.s < _to AND _from < x.e AS INT)").alias("label"), *[f"x.f.{f}" for f in FEATURES])
    return _counted(rows.dropDuplicates(["_o"])), _counted(loose)


def train(docs: DataFrame, text: str = "text", n: int = EXAMPLES, proposals: int = PROPOSALS) -> tuple[float, list, tuple[float, ...]]:
    """Log odds to begin with, trees, and the least score of each kind."""
    spark = docs.sparkSession
    made = examples(n)
    df = small(spark, [(i, t, a, b, y) for i, (t, a, b, y) in enumerate(made)], "i int, text string, a int, b int, y int")
    found = _with_proposals(_with_base(df, "text")).select("i", "y", "a", "b", F.explode("_more").alias("x"))
    own = found.select("i", (F.expr("x.s < b AND a < x.e").cast("int") * F.col("y")).alias("label"), *[F.least(F.col(f"x.f.{f}"), F.lit(float(CLIP))).alias(f) for f in FEATURES]).collect()
    rows = [((r[0] * 2654435761 % 1000) < 1000 * HELD_BACK, r[1], 1.0, *r[2:]) for r in sorted(map(tuple, own))]
    release(spark)
    for some in _from_documents(docs, text):
        share = min(1.0, proposals / max(1, sum(r[2] for r in some)))
        rows += [(r[0], r[1], r[2] * share, *r[3:]) for r in some]
    held = np.array([r[0] for r in rows])
    y, w = (np.array([r[c] for r in rows], float) for c in (1, 2))
    x = np.array([r[3:] for r in rows], float)
    start, grown = trees.boost(x[~held], y[~held], least=LEAF, weight=w[~held])  # single examples, which may be wrong, get no leaf of their own
    z = start + sum(trees.values(t, x) for t in grown)
    limits = []
    for k in range(len(KINDS)):  # the lowest score from which held-back proposals of the kind are right often enough
        own = held & (x[:, 0] == k)
        order = np.flatnonzero(own)[np.argsort(-z[own], kind="stable")]
        right = np.cumsum((w * y)[order]) / np.cumsum(w[order])
        good = np.flatnonzero((right >= PRECISION) & (np.diff(z[order], append=-np.inf) < 0))  # equal scores stay or go together
        limits.append(float(max(z[order][good[-1]] - 1e-4, 0.0)) if len(good) else 1e9)  # the SQL's numbers are rounded
    release(spark)
    return start, grown, tuple(limits)


def detect(docs: DataFrame, text: str = "text", n: int = EXAMPLES, model: tuple | None = None) -> DataFrame:
    """Adds `_base` and `_spans` (base and selected ones), arrays of struct<s, k, e, v> by start, then kind; and `_t`.

    Learns from docs themselves unless a model of train() is given.
    """
    start, grown, limits = model or train(docs, text, n)
    names = [f"x.f.{f}" for f in FEATURES]
    z = f"({start:.6f}D + " + " + ".join(trees.sql(t, names) for t in grown) + ")"
    limit = "CASE x.k " + " ".join(f"WHEN {i} THEN {v:.6f}D" for i, v in enumerate(limits)) + " END"
    out = _with_proposals(_with_base(docs, text))
    out = out.withColumn("_more", F.expr(f"filter(transform(_more, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e, 'v', x.v, 'z', {z} - {limit})), x -> x.z >= 0)"))
    best = survivors("_more", "(CASE WHEN x.z > o.z THEN 2 ELSE 1 END)")
    return out.withColumn("_spans", F.expr(f"CASE WHEN size(_more) = 0 THEN _base ELSE array_sort(concat(_base, transform({best}, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e, 'v', x.v)))) END"))


def _listed(col: str) -> str:
    kind = f"element_at(array({', '.join(map(_quote, KINDS))}), x.k + 1)"
    return f"array_join(transform({col}, x -> concat({kind}, ':', x.s, ':', x.e)), ',')"


def report(docs: DataFrame) -> DataFrame:
    """The query's rows."""
    out = detect(docs.select("doc_id", "text"))
    return out.select("doc_id", *[F.expr(f"CAST(size(filter(_base, x -> x.k = {i})) AS BIGINT)").alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(F.expr(_listed("_base")), 256).alias("base_sha256"), F.expr(_listed("_spans")).alias("spans"))


#: Characters of the blocks that a text is cut into to take pieces from.
PIECE = 1024


def _replaced(t: str, spans_: str) -> str:
    """SQL for text t with its sorted spans as their kinds: runs of overlapping ones as one, by the first one's kind.

    A run begins at a span before whose start all earlier ones have ended: as many ends lie before it as spans.
    """
    starts = "array_sort(concat(transform(S, (q, n) -> named_struct('p', q.s, 't', 1, 'n', n)), transform(S, q -> named_struct('p', q.e, 't', 0, 'n', -1))))"
    runs = f"transform(filter(transform({starts}, (q, n) -> named_struct('t', q.t, 'n', q.n, 'before', n)), q -> q.t = 1 AND q.before = 2 * q.n), q -> q.n)"
    stop = "array_max(transform(slice(S, C[r] + 1, CASE WHEN r + 1 < size(C) THEN C[r + 1] ELSE size(S) END - C[r]), q -> q.e))"
    merged = f"transform(sequence(0, size(C) - 1), r -> named_struct('s', S[C[r]].s, 'e', {stop}, 'k', S[C[r]].k))"
    first, last = f"CAST(f div {PIECE} AS INT)", f"CAST((g - 1) div {PIECE} AS INT)"
    far = f"concat(substring(B[{first}], f % {PIECE} + 1), array_join(slice(B, {first} + 2, {last} - {first} - 1), ''), left(B[{last}], g - {last} * {PIECE}))"
    part = f"CASE WHEN g <= f THEN '' WHEN {first} = {last} THEN substring(B[{first}], f % {PIECE} + 1, g - f) ELSE {far} END"
    piece = lambda a, b: let("f", a, let("g", b, part))
    label = f"element_at(array({', '.join(_quote(f'<{k.upper()}>') for k in KINDS)}), M[r].k + 1)"
    pieces = f"array_join(transform(sequence(0, size(M) - 1), r -> concat({piece('CASE WHEN r = 0 THEN 0 ELSE M[r - 1].e END', 'M[r].s')}, {label})), '')"
    whole = f"concat({pieces}, {piece('element_at(M, -1).e', f'char_length({t})')})"
    blocks = f"regexp_extract_all({t}, '(?s).{{1,{PIECE}}}', 0)"
    return let("S", spans_, let("C", runs, let("M", merged, let("B", blocks, whole))))


def redact(docs: DataFrame, text: str = "text", model: tuple | None = None) -> DataFrame:
    """Each span becomes its kind in angle brackets; overlapping spans are replaced together, by the first one's kind.

    All columns stay, whatever their names; n_chars, if there, is that of the new text. Null text stays null.
    """
    # the row travels as a struct, so that none of its columns can clash
    out = detect(docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_in")), "_in", model=model)
    out = out.withColumn("_new", F.expr(f"CASE WHEN size(_spans) = 0 THEN _in ELSE {_replaced('_in', '_spans')} END"))

    def column(name: str) -> Column:
        if name == text:
            return F.col("_new").alias(name)
        if name == "n_chars":
            return F.when(F.size("_spans") > 0, F.char_length("_new").cast(docs.schema[name].dataType)).otherwise(F.col("_row.n_chars")).alias(name)
        return F.col("_row").getField(name).alias(name)

    return out.select(*map(column, docs.columns))

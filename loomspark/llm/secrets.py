"""Secret scans with a random forest for false-positive removal, in DataFrame functions only.

Generators propose candidates: provider keys, assignments to telling names, private-key headers, web tokens
and long mixed tokens. A random forest judges each by its length, character transitions, dictionary
coverage and make-up, by the path of its document and by the neighbouring words. The dictionary is the WORDS
most frequent words of all documents, besides those that placeholders are made of. The forest is trained on labelled
findings that are written by rule (EXAMPLES of each case) between words of the documents, scored by the same SQL
as the documents; the threshold is the lowest that is precise enough on held-back findings. Of overlapping
candidates the best stays (of equals, the generator listed first), but a web token always stays before one of its
sections.

Null text has no findings, a null path is an unknown one. All work is done in the row that holds the text,
without a shuffle. Repeated rows give repeated findings; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pii, trees
from ._common import small

#: Generators, in order: pattern, and what a text must hold for it to be worth trying. Secrets have no greatest
#: length; possessive groups keep long runs linear.
GENERATORS = {
    "provider": (r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}+|sk_(?:live|test)_[A-Za-z0-9]{16,}+|xox[abprs]-[A-Za-z0-9-]{10,}+)(?![A-Za-z0-9])", "_t RLIKE 'A[KS]IA|gh[pousr]_|sk_|xox'"),
    "assigned": (r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)[\x22']?\s{0,3}+(?::=|=>|=|:)\s{0,3}+[\x22']?[^\s\x22'<>,;]{6,}+", "_t RLIKE '(?i)pass|pwd|secret|token|key|auth'"),
    "header": (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "instr(_t, '-----BEGIN') > 0"),
    "web_token": (r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", "instr(_t, 'eyJ') > 0"),
    "mixed": (r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9])", "_t RLIKE '[A-Za-z0-9+/_-]{20}'"),
}
KINDS = tuple(GENERATORS)
#: Words that placeholders and code are made of, and how many of the documents' own words the dictionary holds besides.
PLACEHOLDERS = "example sample test demo dummy fake change changeme default password secret token key user admin login name value string null none true false here todo path file http https www com org index main src lib data config server client version build release commit class function return item image static assets content page html your".split()
WORDS = 300

_VALUE = r"regexp_replace(x.v, '(?i)^[a-z_ -]+[\\x22\\x27]?\\s*(?::=|=>|=|:)\\s*[\\x22\\x27]?', '')"
FEATURES = ["kind", "length", "transitions", "covered", "distinct", "digits", "upper", "symbols", "hex", "filler", "assigned", "telling", "against", "in_path", "test_path", "code_path"]


def vocabulary(docs: DataFrame, text: str = "text", words: int = WORDS) -> list[str]:
    """The most frequent words of three to twelve small letters in all texts; of equals, the first by name."""
    found = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?<![a-z0-9_])[a-z]{3,12}(?![a-z0-9_])"), F.lit(0))).alias("w"))
    counts = found.groupBy("w").agg(F.count("*").alias("n"))
    return [r["w"] for r in counts.orderBy(F.desc("n"), "w").limit(words).collect()]


def features(path: str, words: list[str]) -> str:
    """SQL for a struct of the features of candidate x (k, s, e, v, b) of a document at the path."""
    v = f"(CASE WHEN x.k = 1 THEN {_VALUE} ELSE x.v END)"
    before = "x.b"
    classes = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({v}, '[a-z]', 'a'), '[A-Z]', 'B'), '[0-9]', '0'), '[^aB0]', '-')"
    part = lambda gone: f"(1 - char_length(regexp_replace({v}, '{gone}', '')) / greatest(1, char_length({v})))"
    made = {
        "kind": "x.k",
        "length": f"char_length({v})",
        "transitions": f"(char_length(regexp_replace({classes}, '(.)\\\\1*', 'x')) - 1) / greatest(1, char_length({v}))",
        "covered": part("(?i)" + "|".join(sorted({*PLACEHOLDERS, *words}, key=lambda w: (-len(w), w)))),
        "distinct": f"size(array_distinct(split({v}, ''))) / least(64, greatest(1, char_length({v})))",  # of 64 characters at most, or long secrets would look dull
        "digits": part("[0-9]"),
        "upper": part("[A-Z]"),
        "symbols": part("[^A-Za-z0-9]"),
        "hex": f"CASE WHEN {v} RLIKE '^(?i)[0-9a-f]+$' THEN 1 ELSE 0 END",
        "filler": f"CASE WHEN {v} RLIKE '(?i)(.)\\\\1{{4}}|[$%{{]|your|1234|abcd' THEN 1 ELSE 0 END",
        "assigned": f"CASE WHEN x.k = 1 OR {before} RLIKE '[=:]\\\\s*[\\\\x22\\\\x27]?$' THEN 1 ELSE 0 END",
        "telling": f"CASE WHEN x.k = 1 OR {before} RLIKE '(?i)pass|secret|token|key|auth|cred' THEN 1 ELSE 0 END",
        "against": f"CASE WHEN {before} RLIKE '(?i)commit|sha|md5|check|digest|uuid|guid|hash|etag|example|sample|image|base64|rev' THEN 1 ELSE 0 END",
        "in_path": f"CASE WHEN {before} RLIKE '[/.]$' OR {v} RLIKE '/[a-z]+/' THEN 1 ELSE 0 END",
        "test_path": f"CASE WHEN {path} RLIKE '(?i)test|example|sample|demo|doc|readme|fixture' THEN 1 ELSE 0 END",
        "code_path": f"CASE WHEN {path} RLIKE '(?i)[.](?:py|js|java|go|rb|env|ya?ml|json|conf|ini|sh)$' THEN 1 ELSE 0 END",
    }
    return "named_struct(" + ", ".join(f"'{k}', CAST({s} AS DOUBLE)" for k, s in made.items()) + ")"


def _with_candidates(docs: DataFrame, text: str, path: str, words: list[str]) -> DataFrame:
    """Adds `_t` and `_found`: candidates (k, s, e, v, f)."""
    none = "CAST(array() AS array<struct<s: int, e: int, v: string, b: string, a: string>>)"
    found = ", ".join(f"transform(CASE WHEN {need} THEN {pii.spans('_t', pattern, True)} ELSE {none} END, x -> named_struct('k', {i}, 's', x.s, 'e', x.e, 'v', x.v, 'b', x.b))" for i, (pattern, need) in enumerate(GENERATORS.values()))
    out = docs.withColumn("_t", pii._clean(text)).withColumn("_p", F.expr(f"coalesce({path}, '')")).withColumn("_found", F.expr(f"concat({found})"))
    return out.withColumn("_found", F.expr(f"transform(_found, x -> named_struct('k', x.k, 's', x.s, 'e', x.e, 'v', x.v, 'f', {features('_p', words)}))"))


#: Labelled findings of each case; the share held back for the threshold; the precision it must reach there.
EXAMPLES, HELD_BACK, PRECISION = 60, 0.3, 0.98


def examples(n: int = EXAMPLES, seed: int = 9, words: list[str] | None = None) -> list[tuple[str, str, int, int, int]]:
    """(path, text, start, end, label) of findings written by rule, between the given words (or made-up ones)."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(chars[int(i)] for i in rng.integers(0, len(chars), k))
    one = lambda *xs: xs[int(rng.integers(len(xs)))]
    low, up, dig, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    mixed = low + up + dig
    long = lambda: int(np.exp(rng.uniform(4.4, 7.7)))  # noqa: E731  # 81 to 2,208
    word = lambda: one(*words) if words and rng.random() < 0.7 else pick(low, int(rng.integers(2, 9)))
    prose = lambda: " ".join(word() for _ in range(int(rng.integers(1, 6))))
    out = []
    for _ in range(n):
        name, sign = one("password", "token", "secret", "api_key", "auth"), one("=", " = ", ": ", "=", ' = "')
        good = [
            f"AKIA{pick(up + dig, 16)}",
            f"ghp_{pick(mixed, 36)}",
            f"{name}{sign}{pick(hexa, int(rng.integers(16, 41)))}",
            f"{name}{sign}{pick(mixed, int(rng.integers(12, 41)))}",
            f"{name}{sign}{pick(mixed + '!#%+-_', int(rng.integers(10, 20)))}",
            "-----BEGIN RSA PRIVATE KEY-----",
            f"eyJ{pick(mixed, 30)}.{pick(mixed, 40)}.{pick(mixed, 30)}",
            f"key {pick(mixed + '+/', 40)}",
            f"{one('ghp_', 'sk_live_', 'xoxb-')}{pick(mixed, long())}",
            f"{name}{sign}{pick(one(hexa, mixed, mixed + '+/-_'), long())}",
            f"eyJ{pick(mixed + '-_', long())}.{pick(mixed + '-_', long())}.{pick(mixed + '-_', long())}",
            f"key {pick(mixed + '+/', long())}",
        ]
        bad = [
            f"{name}{sign}{one('example', 'changeme', 'your_password', 'password123', 'dummyvalue', 'xxxxxxxxxx', 'secretkey', 'test-token', 'default')}",
            f"{name}{sign}{one('process.env.', 'config.', 'os.environ', 'settings.', 'getpass')}{pick(low, 6)}",
            f"{name}{sign}{prose().replace(' ', '')[:12].ljust(6, 'e')}",
            f"commit {pick(hexa, 40)}",
            f"{one('md5', 'sha1', 'checksum', 'etag')} {pick(hexa, 32)}",
            "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)),
            f"/{one('static', 'assets', 'lib')}/{pick(low, 7)}/{pick(low, 8)}-{pick(dig, 2)}/{one('main', 'index')}",
            f"{prose().replace(' ', '_')}_{pick(low, 12)}_{pick(dig, 2)}",
            f"data:{one('image/png', 'font/woff2', 'text/css')};base64,{pick(mixed + '+/', long())}",
            f"{name}{sign}{one('x', 'ab', 'example', 'changeme-') * long()}",
            pick(mixed, int(rng.integers(1, 4))) * long(),
            f"{one('digest', 'checksum', 'sha')} {pick(hexa, long())}",
            "_".join(pick(low, 6) for _ in range(long() // 7)) + pick(dig, 2),
            f"{pick(up, 1)}{pick(low, 8)}{pick(up, 1)}{pick(low, 9)}{pick(dig, 1)}{pick(up, 1)}{pick(low, 5)}",
        ]
        for cases, label in ((good, 1), (bad, 0)):
            for v in cases:
                lead = f"{prose()} "
                path = one("src/app.py", "conf/prod.yml", "", "web", "notes") if label or rng.random() < 0.5 else one("tests/test_a.py", "docs/readme.md", "example.env", "src/app.py", "web")
                out.append((path, f"{lead}{v} {prose()}.", len(lead), len(lead) + len(v), label))
    return out


def train(docs: DataFrame, text: str = "text", n: int = EXAMPLES) -> tuple[list, float, list[str]]:
    """The forest, the least share of its votes, and the dictionary."""
    words = vocabulary(docs, text)
    made = examples(n, words=words)
    df = small(docs.sparkSession, [(i, *r) for i, r in enumerate(made)], "i int, path string, text string, a int, b int, y int")
    found = _with_candidates(df, "text", "path", words).select("i", "y", "a", "b", F.explode("_found").alias("x"))
    rows = found.select("i", (F.expr("x.s < b AND a < x.e").cast("int") * F.col("y")).alias("label"), *[f"x.f.{f}" for f in FEATURES]).collect()
    rows.sort(key=tuple)
    x, y = np.array([r[2:] for r in rows], float), np.array([r[1] for r in rows], float)
    held = np.array([(r[0] * 2654435761 % 1000) < 1000 * HELD_BACK for r in rows])
    grown = trees.forest(x[~held], y[~held])
    p = sum(trees.values(t, x[held]) for t in grown) / len(grown)
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[held][order]) / np.arange(1, held.sum() + 1)
    good = np.flatnonzero(right >= PRECISION)
    return grown, float(max(0.5, p[order][good[-1]])) if len(good) else 0.9, words


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str = "source", n: int = EXAMPLES, model: tuple | None = None) -> DataFrame:
    """One row per finding: id, start, end (code points, end exclusive), kind, score and the digest of the match.

    The dictionary comes from docs themselves unless a model of train() is given.
    """
    grown, limit, words = model or train(docs, text, n)
    names = [f"x.f.{f}" for f in FEATURES]
    p = "(" + " + ".join(trees.sql(t, names) for t in grown) + f") / {len(grown)}D"
    own = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_x"), F.col(path).alias("_y"))
    out = _with_candidates(own, "_x", "_y", words)
    out = out.withColumn("_found", F.expr(f"filter(transform(_found, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e, 'v', x.v, 'p', {p})), x -> x.p >= {limit:.6f}D)"))
    # a mixed token over a web token is one of its sections: the whole one stays
    loser = "(CASE WHEN o.k = 3 AND x.k = 4 THEN 1 WHEN o.k = 4 AND x.k = 3 THEN 2 WHEN x.p > o.p OR (x.p = o.p AND x.k < o.k) THEN 2 ELSE 1 END)"
    best = pii.survivors("_found", loser)
    kind = f"element_at(array({', '.join(map(pii._quote, KINDS))}), x.k + 1)"
    found = out.where("size(_found) > 0").select("_id", F.explode(F.expr(best)).alias("x"))
    return found.select(F.col("_id").alias(id_col), F.expr("CAST(x.s AS BIGINT)").alias("start"), F.expr("CAST(x.e AS BIGINT)").alias("end"), F.expr(kind).alias("kind"), F.expr("round(x.p, 6)").alias("score"), F.expr("sha2(x.v, 256)").alias("secret_sha256"))

"""Grammars, bilingual alignment and terms of marked-up text."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- weighted grammars ---


def sample_sentences(rules: DataFrame, ids: DataFrame, start: str = "START", seed: int = 1, most: int = 100_000) -> DataFrame:
    """(id, sentence): leftmost expansion with rules drawn by weight; weight 0 never.

    rules(lhs, weight, rhs) is a grammar, small by nature: it is collected once and broadcast. A sentence
    depends on its id and the seed only. Expansion ends with an error after `most` steps.
    """
    table: dict[str, tuple[list, list]] = {}
    for r in rules.orderBy("lhs", "rhs", "weight").collect():
        table.setdefault(r["lhs"], ([], []))
        if r["weight"] > 0:
            table[r["lhs"]][0].append(list(r["rhs"]))
            table[r["lhs"]][1].append(r["weight"])
    shared = ids.sparkSession.sparkContext.broadcast(table)

    def run(parts):
        import pandas as pd

        grammar = shared.value
        for p in parts:
            out = []
            for i in p["id"]:
                rng, todo, words, steps = random.Random(f"{seed}:{i}"), [start], [], 0
                while todo:
                    symbol = todo.pop()
                    if symbol not in grammar:
                        words.append(symbol)
                        continue
                    choices, weights = grammar[symbol]
                    if not choices:
                        raise ValueError(f"no rule of {symbol} has weight")
                    todo.extend(reversed(rng.choices(choices, weights)[0]))
                    steps += 1
                    if steps > most:
                        raise ValueError("the expansion is too long")
                out.append(" ".join(words))
            yield pd.DataFrame({"id": p["id"], "sentence": out})

    return ids.select(F.col("id").cast("long")).mapInPandas(run, "id long, sentence string")


def bigram_rules(tagged: DataFrame, start: str = "S2") -> DataFrame:
    """(lhs, weight, rhs) of a grammar that walks from tag to tag as often as tagged (id, position, tag, word) does.

    A state `_T` gives a word of tag T and the state of the tag that follows, or the word alone where a sentence ends.
    """
    following = F.lead("tag").over(Window.partitionBy("id").orderBy("position"))  # a sentence is a window of its own
    place = F.row_number().over(Window.partitionBy("id").orderBy("position"))
    steps = tagged.select("tag", "word", following.alias("then"), place.alias("nr"))
    state = lambda c: F.concat(F.lit("_"), c)
    first = steps.where("nr = 1").select(F.lit(start).alias("lhs"), F.array(state(F.col("tag"))).alias("rhs"))
    move = steps.select(state(F.col("tag")).alias("lhs"), F.when(F.col("then").isNull(), F.array("tag")).otherwise(F.array("tag", state(F.col("then")))).alias("rhs"))
    word = steps.select(F.col("tag").alias("lhs"), F.array("word").alias("rhs"))
    return first.unionByName(move).unionByName(word).groupBy("lhs", "rhs").agg(F.count("*").cast("int").alias("weight")).select("lhs", "weight", "rhs")


# --- alignment by inversion transduction ---

#: Fixed value: what a word without a partner stands against in a derivation.
NOTHING = "EPSILON"
#: Pairs of a dictionary that is sent to the tasks.
WORDS = 2_000_000


class Aligner:
    """Best bracketing of a sentence pair under word scores and rule scores.

    A chart item is a pair of spans. Its best score is that of a word pair, of a word against nothing, or of
    two items side by side, in the same order on both sides or reversed on one. Items are filled by growing
    source length, then source start, target length and target start, and a later derivation replaces an
    earlier one only if it scores more; this order decides between equals.
    """

    def __init__(self, scores: dict[tuple[str, str], float], same: float = -1, reverse: float = -2, no_target: float = -20, no_source: float = -21, swap: bool = True):
        self.scores, self.same, self.reverse, self.no_target, self.no_source, self.swap = scores, same, reverse, no_target, no_source, swap

    def __call__(self, source: str, target: str) -> str | None:
        a, b = source.split(), target.split()
        n, m = len(a), len(b)
        if not n or not m:
            return None
        best: dict[tuple[int, int, int, int], float] = {}
        how: dict[tuple[int, int, int, int], object] = {}
        for i, s in enumerate(a):
            for j, t in enumerate(b):
                if (s, t) in self.scores:
                    best[i, 1, j, 1], how[i, 1, j, 1] = self.scores[s, t], f"{s}/{t}"
                best[i, 1, j, 0], how[i, 1, j, 0] = self.no_target, f"{s}/{NOTHING}"
                best[i, 0, j, 1], how[i, 0, j, 1] = self.no_source, f"{NOTHING}/{t}"
        for sl in range(n + 1):
            for i in range(n - sl + 1 if sl else n):
                for tl in range(m + 1):
                    for j in range(m - tl + 1 if tl else m):
                        self._fill(best, how, i, sl, j, tl, n, m)
        whole = (0, n, 0, m)
        return self._show(how, whole) if whole in best else None

    def _fill(self, best, how, i, sl, j, tl, n, m) -> None:
        item = (i, sl, j, tl)
        score = best.get(item)
        get = best.get
        for x in range(min(sl, n - 1 - i) + 1):
            for y in range(min(tl, m - 1 - j) + 1):
                rest = (i + x, sl - x, j + y, tl - y)
                first = (i, x, j, y)
                p, q = get(first), get(rest)
                if p is not None and q is not None and (score is None or p + q + self.same > score):
                    score = best[item] = p + q + self.same
                    how[item] = ("[", "]", how[first], how[rest])
                if self.swap:
                    first, rest = (i, x, j + y, tl - y), (i + x, sl - x, j, y)
                    p, q = get(first), get(rest)
                    if p is not None and q is not None and (score is None or p + q + self.reverse > score):
                        score = best[item] = p + q + self.reverse
                        how[item] = ("<", ">", how[first], how[rest])

    @staticmethod
    def _show(how, item) -> str:
        out, todo = [], [how[item]]
        while todo:
            d = todo.pop()
            if isinstance(d, str):
                out.append(d)
            else:
                out.append(d[0])
                todo += [d[1], d[3], d[2]]
        return " ".join(out)


def align(pairs: DataFrame, dictionary: DataFrame, swap: bool = True) -> DataFrame:
    """(id, tree) of pairs(id, source, target); a chart never leaves its row.

    dictionary(src, tgt, score) is broadcast, WORDS pairs at most; of equal pairs, the largest score holds.
    """
    rows = dictionary.groupBy("src", "tgt").agg(F.max("score").alias("score")).limit(WORDS + 1).collect()
    if len(rows) > WORDS:
        raise ValueError(f"a dictionary of more than {WORDS} pairs isn't broadcast")
    scores = {(r["src"], r["tgt"]): r["score"] for r in rows}
    shared = pairs.sparkSession.sparkContext.broadcast(scores)

    def run(parts):
        import pandas as pd

        aligner = Aligner(shared.value, swap=swap)
        for p in parts:
            yield pd.DataFrame({"id": p["id"], "tree": [aligner(s or "", t or "") for s, t in zip(p["source"], p["target"], strict=True)]})

    return pairs.select(F.col("id").cast("long"), "source", "target").mapInPandas(run, "id long, tree string")


def alignment_counts(trees: DataFrame) -> DataFrame:
    """Word pairs, words against nothing on either side, and both kinds of brackets, from the tokens of the derivations."""
    token = trees.select("tree", F.explode_outer(F.split("tree", " ")).alias("x"))
    x = F.col("x")
    kind = F.when(x == "[", "in_order").when(x == "<", "reversed").when(x.startswith(f"{NOTHING}/"), "target_only").when(x.endswith(f"/{NOTHING}"), "source_only").when(F.instr("x", "/") > 0, "translations")
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("translations", "source_only", "target_only", "in_order", "reversed")]
    return trees.agg(F.count("tree").alias("alignments")).crossJoin(token.select(kind.alias("kind")).agg(*counts))


# --- transducers ---


def compose(a: DataFrame, b: DataFrame) -> DataFrame:
    """Arcs (state, next, input, output) of the composition of two arc tables without empty symbols: a join."""
    pair = lambda x, y: F.concat_ws("|", x, y)
    x, y = (t.select(*[F.col(c).alias(f"{p}{c}") for c in ("state", "next", "input", "output")]) for p, t in (("a", a), ("b", b)))
    return x.join(y, F.col("aoutput") == F.col("binput")).select(pair("astate", "bstate").alias("state"), pair("anext", "bnext").alias("next"), F.col("ainput").alias("input"), F.col("boutput").alias("output"))


def terms(text: Column, tags: Column, mentions: Column) -> Column:
    """Distinct words of plain text with #tags and @mentions."""
    from loomspark.functions.text import word_set
    from loomspark.operators.relational import feature_terms

    return feature_terms(word_set(text), tags, mentions)

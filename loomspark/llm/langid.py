"""Language identification by compression with per-language zstandard raw-content dictionaries.

Text is lower-cased, everything but letters becomes single spaces, and the whole text is compressed in
blocks of 1 KB with each language's dictionary: block by block, because a long text would otherwise become its own
dictionary. The language with the fewest bytes in all wins; where the relative margin to the second is narrow, the
document counts as rejected.

Every row that may be learned from teaches. A dictionary holds the words that cover most bytes of all texts of its
language, as many as SIZE bytes take, the most telling last, where zstandard refers to them most cheaply. How narrow a
margin must be is learned from the same rows, each judged by dictionaries of those texts only that fall into the other
half by hash: margins, in steps of 1 / STEPS, are rejected from zero up to where that takes away most wrong predictions,
each worth COST right ones that go with them. Repeated rows count one by one. Null text, or text without a letter, gives
`und` with score 0 and is rejected; so does every text where nothing could be learned. Ties go to the language that sorts
first, and are rejected.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import fresh, held_out, release, ship, small, tidied

#: Bytes of a dictionary, and of a word in it at most (a longer one counts by its beginning).
SIZE, WORD = 65_536, 48
LEVEL, BLOCK = 6, 1024
#: Languages that are learned at most, steps of the margin, and what a wrong prediction weighs.
LANGUAGES, STEPS, COST = 256, 10_000, 2.0
#: Words that a task counts before it hands them on.
COUNTED = 200_000

#: Letters of ASCII and bytes of longer characters stay; all else is a space.
_KEEP = bytes(c if chr(c).isalpha() and c < 128 or c > 127 else 32 for c in range(256))


def normal(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_KEEP).split())


@dataclass(frozen=True)
class Model:
    """Dictionary of each learned language, in the order of the languages, and the margin up to which a document is rejected."""

    dictionaries: tuple[tuple[str, bytes], ...]
    narrow: float = 0.0


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int | None = None, size: int = SIZE) -> Model:
    """Dictionaries and margin from all rows with text and language; the caller leaves out held-out rows. `sample` has no effect."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    by_lang = rows.groupBy("lang").agg(F.countDistinct(F.xxhash64("text")).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    langs = [r["lang"] for r in by_lang.collect()]
    if not langs:
        return Model(())
    spark = docs.sparkSession
    keep = small(spark, [(k,) for k in langs], "lang string")  # a row for each language
    rows = rows.withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "text"), F.lit(2)).cast("int")).join(F.broadcast(keep), "lang")
    halves = dictionaries(rows, size)
    release(spark)
    model = Model(halves.get(None, ()))
    if len(model.dictionaries) < 2:
        return model
    seen: dict[tuple[int, bool], int] = {}
    for half in (0, 1):
        other = Model(halves.get(1 - half, ()))
        if len(other.dictionaries) < 2:
            continue
        said = classify(rows.where(F.col("half") == half), other, "lang").where(F.col("lang").isin([k for k, _ in other.dictionaries]))
        found = said.where("lang_pred <> 'und'").groupBy(_step().alias("step"), (F.col("lang_pred") == F.col("lang")).alias("right")).count()
        for r in found.collect():  # two rows a step at most
            seen[r["step"], r["right"]] = seen.get((r["step"], r["right"]), 0) + r["count"]
    release(spark)
    return Model(model.dictionaries, narrow_of([(step / STEPS, right, n) for (step, right), n in sorted(seen.items())]))


def _step():
    """The margin in whole steps, upwards: only a tie has 0."""
    return F.ceil(F.col("margin") * STEPS).cast("int")


def dictionaries(rows: DataFrame, size: int = SIZE) -> dict[int | None, tuple[tuple[str, bytes], ...]]:
    """Of (text, lang, half): each half's dictionaries by language, and under None those of all rows."""
    import pyarrow as pa

    ship(rows.sparkSession)
    names = ["lang", "half", "word", "n"]

    def run(parts):
        counts: dict[tuple[str, int], Counter] = {}

        def made():
            cols = [[k[0] for k, c in counts.items() for _ in c], [k[1] for k, c in counts.items() for _ in c], [w for c in counts.values() for w in c], [n for c in counts.values() for n in c.values()]]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.string(), pa.int32(), pa.binary(), pa.int64()), strict=True)], names)

        for part in parts:
            for text, lang, half in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                own = counts.setdefault((lang, half), Counter())
                own.update(w[:WORD] for w in normal(text).split())
                if len(own) > COUNTED or len(counts) * 1000 > COUNTED and sum(map(len, counts.values())) > COUNTED:
                    yield made()
        if counts:
            yield made()

    found = rows.select("text", "lang", "half").mapInArrow(tidied(run), "lang string, half int, word binary, n long")
    found = found.groupBy("lang", "half", "word").agg(F.sum("n").alias("n"))
    whole = F.explode(F.array(F.col("half"), F.lit(-1)))
    weight = found.select("lang", whole.alias("half"), "word", "n").groupBy("lang", "half", "word").agg((F.sum("n") * (F.length("word") + 1)).alias("n"))
    by = Window.partitionBy("lang", "half").orderBy(F.desc("n"), "word")
    # a word and its space take two bytes at least: what lies beyond is dropped where it is counted
    some = weight.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= size // 2)
    some = some.withColumn("end", F.sum(F.length("word") + 1).over(by.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("end") <= size)
    lists = some.groupBy("lang", "half").agg(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("r"), "word"))).alias("words"))  # SIZE bytes
    out: dict[int | None, list] = {}
    for r in lists.collect():
        text = b" ".join(bytes(w["word"]) for w in r["words"])
        if len(text) >= 8:  # zstandard takes no smaller dictionary
            out.setdefault(None if r["half"] < 0 else r["half"], []).append((r["lang"], text))
    return {k: tuple(sorted(v)) for k, v in out.items()}


def narrow_of(seen: list[tuple]) -> float:
    """The margin up to which rejecting pays most: COST for each wrong prediction, less one for each right one.

    Of (margin, right) or (margin, right, number of them), sorted.
    """
    best, value, gain = 0.0, 0.0, 0.0
    for i, (margin, right, *n) in enumerate(seen):
        gain += (-1.0 if right else COST) * (n[0] if n else 1)
        if gain > value and (i + 1 == len(seen) or seen[i + 1][0] > margin):
            best, value = margin, gain
    return best


class Classifier:
    def __init__(self, model: Model):
        import regex
        import zstandard as Z

        self.letter = regex.compile(r"\p{L}")
        self.langs = [k for k, _ in model.dictionaries]
        self.packers = []
        for _, text in model.dictionaries:
            params = Z.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(text), write_content_size=0, write_checksum=0, write_dict_id=0)
            d = Z.ZstdCompressionDict(text, dict_type=Z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.packers.append(Z.ZstdCompressor(dict_data=d, compression_params=params))

    def sizes(self, text: str) -> list[int]:
        raw = normal(text)
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return [sum([len(p.compress(b)) for b in blocks]) for p in self.packers]

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and relative margin."""
        if not text or not self.packers or not self.letter.search(text):
            return "und", 0.0, 0.0
        sizes = self.sizes(text)
        if len(sizes) == 1:
            return self.langs[0], 1.0, 1.0
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = 1 - sizes[best] / second
        return self.langs[best], 0.5 + 0.5 * min(1.0, 4 * margin), margin


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, score, margin and rejected to each row; one narrow pass.

    By default only the id and these come back; `keep` names other columns to carry along.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # SIZE bytes for each of LANGUAGES at most
    carried = [id_col] if keep is None else keep
    narrow = model.narrow
    made: list[Classifier] = []

    def run(parts):
        if not made:
            made.append(Classifier(shared.value))
        for part in parts:
            for start in range(0, part.num_rows, 500):
                own = part.slice(start, 500)
                found = list(map(made[0], own.column(own.num_columns - 1).to_pylist()))
                cols = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64()), pa.array([f[0] == "und" or f[2] <= narrow for f in found], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], *cols], [*[f"c{i}" for i in range(len(carried))], "lang_pred", "score", "margin", "rejected"])

    types = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carried))
    out = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(carried)], docs[text_col].alias("text"))
    out = out.mapInArrow(tidied(run), f"{types}, lang_pred string, score double, margin double, rejected boolean")
    return out.toDF(*carried, *[fresh(n, carried) for n in ("lang_pred", "score", "margin", "rejected")])


def identify(docs: DataFrame) -> DataFrame:
    """The query's rows: learn from the rows that aren't held out, predict for all."""
    model = fit(docs.where(~held_out()))
    out = classify(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows whose language is told apart, with the columns they came with."""
    out = classify(docs, fit(docs.where(~held_out())), keep=docs.columns)
    return out.where(~F.col(out.columns[-1])).select(*docs.columns)

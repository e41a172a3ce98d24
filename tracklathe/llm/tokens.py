"""Encoding texts with a public byte-level BPE vocabulary by Spark expressions, and decoding."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklathe.session import cut, settle

#: The vocabulary's folder; a parameter everywhere, this is its default place.
FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Fixed value: how the vocabulary splits a text into words, with Unicode white space as the tokenizers understand it.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """The vocabulary: bytes of each token to its id, which is its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


SALTS = 16
STEP, MIX, PRIME = 1021, (1103515245, 1664525), 4294967291


class _Table:
    """A perfect hash of 64-bit keys to ints, built here and read by column expressions on three arrays.

    Each key comes with two numbers below 2**32, low and high. Its bucket is low % buckets; with the bucket's
    displacement d its slot is (high + d * (1 + high % STEP)) % slots. Slots without a key hold -1.
    """

    def __init__(self, items: list[tuple[int, int, int, int]], per_bucket: int = 4, load: float = 0.6):
        n_buckets, n_slots = max(1, len(items) // per_bucket) | 1, int(len(items) / load) | 1
        groups: list[list[tuple[int, int, int, int]]] = [[] for _ in range(n_buckets)]
        for item in items:
            groups[item[1] % n_buckets].append(item)
        groups_by_size = sorted(range(n_buckets), key=lambda i: -len(groups[i]))
        while True:
            shift, keys, values, taken = [0] * n_buckets, [-1] * n_slots, [0] * n_slots, bytearray(n_slots)
            for b in groups_by_size:
                for d in range(5000):
                    at = [(high + d * (1 + high % STEP)) % n_slots for _, _, high, _ in groups[b]]
                    if len(set(at)) == len(at) and not any(taken[i] for i in at):
                        break
                else:
                    break
                shift[b] = d
                for i, (key, _, _, value) in zip(at, groups[b]):
                    keys[i], values[i], taken[i] = key, value, 1
            else:
                break
            n_slots += 2
        self.n, self.m = n_buckets, n_slots
        self.arrays = (shift, keys, values)

    def get(self, arrays: Column, key: Column, low: Column, high: Column) -> Column:
        d = arrays["shift"][(low % self.n).cast("int")].cast("bigint")
        slot = ((high + d * (1 + high % STEP)) % self.m).cast("int")
        return F.when(arrays["keys"][slot] == key, arrays["values"][slot])


def _let(value: Column, body) -> Column:
    """The body with the value as a variable, so that it is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class ByteBpe:
    """Column expressions of one vocabulary. ``path`` is a file of lines: a token in base 64, its rank.

    The rank map is a constant of the plan, a scalar subquery over one local row of arrays of about two megabytes: a
    literal of that size would be written out in every plan description.
    """

    def __init__(self, spark: SparkSession, path: str = f"{FOLDER}/byte_bpe_50k.tiktoken"):
        self.path = path
        vocabulary = ranks(path)
        self.size = max(vocabulary.values()) + 1
        pairs = {}
        for token, i in vocabulary.items():
            for cut in range(1, len(token)):
                a, b = vocabulary.get(token[:cut]), vocabulary.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = i
        if self.size**2 > PRIME:
            raise ValueError("the vocabulary has too many tokens for the pair keys")
        self._pairs = _Table([(k, k * MIX[0] % PRIME, k * MIX[1] % PRIME, i) for k, i in pairs.items()])
        whole = [(xxhash.xxh64_intdigest(token, seed=42), i) for token, i in vocabulary.items()]
        self._whole = _Table([(h - (h >> 63 << 64), h & 0xFFFFFFFF, h >> 32, i) for h, i in whole if h != 2**64 - 1])
        hexes = [""] * self.size
        for token, i in vocabulary.items():
            hexes[i] = token.hex()
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())

        def constant(**arrays: pa.Array) -> Column:
            rows = spark.createDataFrame(pa.table(arrays))
            return rows.select(F.struct(*rows.columns)).scalar()

        def three(t: _Table) -> dict[str, pa.Array]:
            return {n: pa.array([x], k) for n, x, k in zip(("shift", "keys", "values"), t.arrays, (ints, longs, ints))}

        #: Columns to add to a frame before the expressions that name them; the optimizer writes them in, no row carries them.
        self.merges = constant(**three(self._pairs), bytes=pa.array([[vocabulary[bytes([b])] for b in range(256)]], ints))
        self.whole = constant(**three(self._whole))
        self.pieces = constant(hex=pa.array([hexes], pa.list_(pa.string())))
        self._pairs.arrays = self._whole.arrays = ()

    def _merged(self, arrays: Column, a: Column, b: Column) -> Column:
        """The id, which is the rank, of the token that two neighbours make together; null if they make none."""
        key = a.cast("bigint") * self.size + b
        return self._pairs.get(arrays, key, key * MIX[0] % PRIME, key * MIX[1] % PRIME)

    def id_of_whole(self, word: Column, whole: Column) -> Column:
        """The id of a word that is one token, by its 64-bit hash; null for other words.

        The text is not compared, which would double the cost of every word: one of ten billion distinct words is taken for a
        token it is not with a chance of about one in 40 000 for the whole corpus.
        """
        return _let(whole, lambda t: _let(F.xxhash64(word), lambda h: self._whole.get(t, h, h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))))

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))

    def ids_of_word(self, word: Column, merges: Column) -> Column:
        """Folds ranked merges over the word's bytes: each step joins the leftmost pair of lowest rank."""
        return _let(merges, lambda t: self._folded(word, t, t["bytes"]))

    def _folded(self, word: Column, pairs: Column, of_byte: Column) -> Column:
        at = F.transform(F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), ""), lambda c: of_byte[F.ascii(c)])
        none = F.array().cast("array<int>")

        def begin(ids: Column) -> Column:
            ranks = F.zip_with(F.slice(ids, 1, F.size(ids) - 1), F.slice(ids, F.lit(2), F.size(ids) - 1), lambda a, b: self._merged(pairs, a, b))
            return F.struct(ids.alias("ids"), ranks.alias("ranks"))

        def step(state: Column, best: Column) -> Column:
            ids, rank = state["ids"], state["ranks"]
            j = F.array_position(rank, best).cast("int")
            left = F.when(j > 1, F.array_append(F.slice(rank, F.lit(1), j - 2), self._merged(pairs, F.get(ids, j - 2), best))).otherwise(none)
            right = F.when(j < F.size(rank), F.array_prepend(F.slice(rank, j + 2, F.greatest(F.size(rank) - j - 1, F.lit(0))), self._merged(pairs, best, F.get(ids, j + 1)))).otherwise(none)
            joined = F.concat(F.slice(ids, F.lit(1), j - 1), F.array(best), F.slice(ids, j + 2, F.greatest(F.size(ids) - j - 1, F.lit(0))))
            return F.struct(joined.alias("ids"), F.concat(left, right).alias("ranks"))

        def fold(state: Column, _: Column) -> Column:
            best = F.array_min(state["ranks"])
            return F.when(best.isNull(), state).otherwise(_let(best, lambda b: step(state, b)))

        turns = F.sequence(F.lit(1), F.greatest(F.size(at) - 1, F.lit(1)))
        whole = _let(at, lambda ids: _let(begin(ids), lambda s: F.aggregate(turns, s, fold)["ids"]))
        return F.when(F.octet_length(word) > 0, whole).otherwise(none)

    def decoded(self, ids: Column, pieces: Column) -> Column:
        """The text of token ids: binary pieces laid end to end, read as UTF-8."""
        return _let(pieces, lambda t: F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: t["hex"][i]), "")), "UTF-8"))


class _Dictionary:
    """The corpus' most frequent words of several tokens, with their ids, as a constant of the plan.

    It has at most ``most`` words of at most ``longest`` bytes, whatever the corpus: some megabytes by default.
    A word is found by its hash and then compared as text.
    """

    def __init__(self, spark: SparkSession, words: DataFrame, bpe: ByteBpe, most: int, longest: int):
        top = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.octet_length("word") <= longest).orderBy(F.desc("n"), "word").limit(most)
        got = top.select("word").repartition(words.sparkSession.sparkContext.defaultParallelism, "word").withColumn("_c", bpe.merges).select("word", bpe.ids_of_word(F.col("word"), F.col("_c")).alias("ids")).toArrow()
        names, ids = got.column("word").to_pylist(), got.column("ids").to_pylist()
        hashes = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in names]
        once = {h: i for i, h in enumerate(hashes) if h != 2**64 - 1}  # of two words with one hash the other goes the long way
        self._table = _Table([(h - (h >> 63 << 64), h & 0xFFFFFFFF, h >> 32, i) for h, i in once.items()])
        starts = [0]
        for x in ids:
            starts.append(starts[-1] + len(x))
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        shift, keys, values = self._table.arrays
        arrays = {"shift": ([shift], ints), "keys": ([keys], longs), "values": ([values], ints), "words": ([names], pa.list_(pa.string())), "starts": ([starts], ints), "ids": ([[i for x in ids for i in x]], ints)}
        rows = spark.createDataFrame(pa.table({k: pa.array(v, t) for k, (v, t) in arrays.items()}))
        self.constant = rows.select(F.struct(*rows.columns)).scalar()

    def ids_in(self, word: Column, constant: Column) -> Column:
        """The word's ids; null for a word that isn't in here."""
        def found(t: Column, h: Column) -> Column:
            return _let(self._table.get(t, h, h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)), lambda i: F.when(t["words"][i] == word, F.slice(t["ids"], t["starts"][i] + 1, t["starts"][i + 1] - t["starts"][i])))

        return _let(constant, lambda t: _let(F.xxhash64(word), lambda h: found(t, h)))


def encoded(documents: DataFrame, bpe: ByteBpe, id_col: str = "doc_id", text_col: str = "text", dictionary: int = 1 << 17, longest: int = 64) -> DataFrame:
    """Each row's token ids, without special tokens: (id, ``ids``), one row for every row of the input.

    Null and empty texts have the empty list. Repeated rows come out as often as they stand, a null id is kept, other
    columns are ignored.

    A first pass counts the words that aren't one token, combined before the shuffle; each distinct one is folded once.
    The ``dictionary`` most frequent of them (up to ``longest`` bytes) are then looked up in the row, as are single
    tokens, so nearly all texts are done without a shuffle. Texts with other words are joined with those words' folds and
    put together by place: the same result by the longer way, for a corpus of any vocabulary.
    """
    spark, text = documents.sparkSession, F.col(text_col)
    rows = documents.select(F.col(id_col).alias("_id"), F.coalesce(bpe.words(text), F.array().cast("array<string>")).alias("_w")).withColumn("_c", bpe.whole)
    hard = rows.select(F.explode(F.filter("_w", lambda w: bpe.id_of_whole(w, F.col("_c")).isNull())).alias("word"))
    frequent = _Dictionary(spark, hard, bpe, dictionary, longest)
    rows = rows.withColumn("_d", frequent.constant)
    ids_of = lambda w: _let(bpe.id_of_whole(w, F.col("_c")), lambda i: F.when(i.isNotNull(), F.array(i)).otherwise(frequent.ids_in(w, F.col("_d"))))
    rows = settle(rows.select("_id", "_w", F.transform("_w", ids_of).alias("_p")))
    done = ~F.exists("_p", lambda p: p.isNull())
    parts = F.zip_with("_w", "_p", lambda w, p: F.struct(p.alias("ids"), F.when(p.isNull(), w).alias("word")))
    rows = cut(rows.select("_id", F.monotonically_increasing_id().alias("_row"), F.when(done, F.flatten("_p")).alias("ids"), F.when(~done, parts).alias("_parts")))
    whole = rows.where("ids is not null").select(F.col("_id").alias(id_col), "ids")
    rest = rows.where("ids is null").select("_id", "_row", F.posexplode("_parts").alias("pos", "p")).select("_id", "_row", "pos", "p.ids", "p.word")
    # words too long for the dictionary may be frequent, such as rulers: their joins are salted
    salt = lambda of: F.when(F.octet_length("word") > longest, of).otherwise(F.lit(0))
    open_words = rest.where("word is not null").withColumn("_salt", salt(F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")))
    folded = open_words.select("word").distinct().withColumn("_c", bpe.merges).select("word", bpe.ids_of_word(F.col("word"), F.col("_c")).alias("ids"))
    folded = folded.withColumn("_salt", F.explode(F.sequence(F.lit(0), salt(F.lit(SALTS - 1)))))
    both = rest.where("word is null").drop("word").unionByName(open_words.drop("ids").join(folded, ["word", "_salt"]).drop("word", "_salt"))
    together = both.groupBy("_row", "_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("_parts"))
    return whole.unionByName(together.select(F.col("_id").alias(id_col), F.flatten(F.transform("_parts", lambda p: p["ids"])).alias("ids")))


def decoded(ids: DataFrame, bpe: ByteBpe, ids_col: str = "ids", name: str = "text") -> DataFrame:
    """Adds the text of each row's token ids; an empty list gives the empty text, null gives null."""
    rest = [c for c in ids.columns if c != name]
    return ids.withColumn("_c", bpe.pieces).select(*rest, bpe.decoded(F.col(ids_col), F.col("_c")).alias(name))

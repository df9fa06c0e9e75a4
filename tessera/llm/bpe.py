"""BPE encoding and decoding of whole texts with a public tokenizer file.

White space ends every pre-token of the supported tokenizers, so a text is the sequence of its
words; each distinct word is encoded once a worker and its ids are reused. What white space does
not split is encoded by tree concatenation: a long pre-token is halved down to leaves, the leaves
are encoded in parallel tasks, and neighbours are joined by encoding a growing window around the
join until it agrees with both sides. Long texts are cut at white space, their parts encoded in
parallel too, and put together again.
"""

import hashlib
import os
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG_TEXT = 1 << 16  # characters of a text that one task encodes in one go
LONG_WORD = 2048  # characters without white space from which on halves are encoded apart
CACHED_WORDS = 240_000
#: Unicode's White_Space; str.split() also splits at 0x1C-0x1F, which are no white space there.
_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ODD = re.compile("[\x1c-\x1f]")
_PIECE = re.compile("[A-Za-z]+|[0-9]|[^A-Za-z0-9]+")
_loaded: dict[str, "Codec"] = {}


def split_words(text: str) -> list[str]:
    return [w for w in _BLANK.split(text) if w] if _ODD.search(text) else text.split()


class Codec:
    """A tokenizer with its word cache; one for each worker process and file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.suffix = self.tokenizer.model.end_of_word_suffix or ""
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.token = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.spelt = [str(i) for i in range(size)]
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.last = [t.endswith(self.suffix) for t in self.token] if self.suffix else []
        self.known: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}
        self.turn = False

    @classmethod
    def load(cls, path: str) -> "Codec":
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def learn(self, words: set[str]) -> None:
        """Encodes those words that aren't known yet: (number of ids, ids and tokens joined by spaces).

        Two generations of CACHED_WORDS / 2 words: what isn't used while one fills up is forgotten.
        """
        new = []
        for w in words:
            if w not in self.known:
                if (x := self.older.get(w)) is None:
                    new.append(w)
                else:
                    self.known[w] = x
        plain = [w for w in new if w.isascii() and "'" not in w and "<|" not in w] if self.suffix else []
        for i in range(0, len(plain), 5000):
            self._learn_together(plain[i : i + 5000])
        rest = [w for w in new if w not in self.known]
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self._keep(w, e.ids)
        self.turn = len(self.known) > CACHED_WORDS // 2

    def _learn_together(self, words: list[str]) -> None:
        """Encodes words in few long texts and cuts the ids where pre-tokens end. A word of letters is
        one pre-token; others are counted."""
        texts = [words[i : i + 100] for i in range(0, len(words), 100)]
        for some, e in zip(texts, self.tokenizer.encode_batch_fast([" ".join(t) for t in texts], add_special_tokens=False)):
            ids, at, last = e.ids, 0, self.last
            counts = [1 if w.isalpha() else len(_PIECE.findall(w)) for w in some]
            if sum([last[i] for i in ids]) != sum(counts):
                continue  # encoded one by one
            for w, n in zip(some, counts):
                start = at
                while n:
                    n -= last[ids[at]]
                    at += 1
                self._keep(w, ids[start:at])

    def _keep(self, word: str, ids: list[int]) -> None:
        self.known[word] = (len(ids), " ".join([self.spelt[i] for i in ids]), " ".join([self.token[i] for i in ids]))

    def age(self) -> None:
        """Forgets what wasn't used lately; called between texts."""
        if self.turn:
            self.older, self.known, self.turn = self.known, {}, False

    def ids_of(self, words: list[str]) -> list[int]:
        self.learn(set(words))
        ids = [int(i) for w in words for i in self.known[w][1].split()]
        self.age()
        return ids

    def decode(self, ids: list[int]) -> str:
        if self.tokenizer.decoder is None:
            return " ".join([self.token[i] for i in ids])
        return self.tokenizer.decode(ids, skip_special_tokens=False)

    def tokenize(self, piece: str) -> list[int]:
        """The ids of one pre-token, in the byte alphabet of the vocabulary."""
        return [t.id for t in self.tokenizer.model.tokenize(piece)]

    def spelling(self, i: int) -> str:
        return self.token[i].removesuffix(self.suffix) if self.suffix else self.token[i]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of a pre-token from those of its halves.

        Two token lists of a BPE agree for good once they share a token at one place: which
        tokens may stand beside a token doesn't depend on what is further away.
        """
        if not left or not right:
            return left or right
        grow = 8
        while True:
            i, j = max(0, len(left) - grow), min(len(right), grow)
            l_text = [self.spelling(t) for t in left[i:]]
            r_text = [self.spelling(t) for t in right[:j]]
            middle = sum(map(len, l_text))
            window = self.tokenize("".join(l_text) + "".join(r_text))
            starts, at = {}, 0
            for n, t in enumerate(window):
                starts[at] = n
                at += len(self.spelling(t))
            left_agrees = i == 0 or window[0] == left[i]
            if left_agrees and j == len(right):
                return left[:i] + window
            at = middle
            for n in range(j - 1 if left_agrees else 0):  # the window's own end isn't the word's
                k = starts.get(at)
                if k is not None and window[k] == right[n] and k + 1 < len(window):
                    return left[:i] + window[:k] + right[n:]
                at += len(r_text[n])
            grow *= 2

    def concatenate(self, leaves: list[list[int]]) -> list[int]:
        """Joins neighbours pairwise, level by level."""
        while len(leaves) > 1:
            leaves = [self.join(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0] if leaves else []

    def units(self, text: str, long_text: int, long_word: int) -> Iterator[tuple[str, int, str]]:
        """Cuts a text into parts that can be encoded apart: (kind, number of the pre-token, text)."""
        held, size, piece_no = [], 0, 0
        for w in split_words(text):
            if len(w) <= long_word:
                held.append(w)
                size += len(w) + 1
                if size > long_text:
                    yield "words", -1, " ".join(held)
                    held, size = [], 0
                continue
            if held:
                yield "words", -1, " ".join(held)
                held, size = [], 0
            for part in self.special.split(w) if self.special else [w]:
                if self.special and self.special.fullmatch(part):
                    yield "words", -1, part
                elif part:
                    norm = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
                    for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(norm):
                        piece_no += 1
                        for leaf in halves(piece, long_word):
                            yield "leaf", piece_no, leaf
        if held:
            yield "words", -1, " ".join(held)


def halves(piece: str, limit: int) -> list[str]:
    if len(piece) <= limit:
        return [piece]
    m = len(piece) // 2
    return halves(piece[:m], limit) + halves(piece[m:], limit)


def _is_long(text: str, words: list[str], long_text: int, long_word: int) -> bool:
    return len(text) > long_text or (len(text) > long_word and max(map(len, words), default=0) > long_word)


def _sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"
VALUES = "ids array<int>, decoded string"


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, long_text: int = LONG_TEXT, long_word: int = LONG_WORD) -> DataFrame:
    """Encodes each text without special tokens added, and decodes the ids again.

    Returns (id, ids, decoded), or with `digests` (id, n_tokens, ids_sha256, decoded_sha256),
    one row for each row of `df`, repeated ids included. A null text is an empty one and has no
    tokens; other columns are left out. An empty table gives an empty one.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    out_schema = f"id {id_type}, {DIGESTS if digests else VALUES}"
    fields = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(path)
        plain = codec.tokenizer.decoder is None
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part = batch.slice(first, 200)
                texts = part.column("text").to_pylist()
                split = [split_words(t) for t in texts]
                keep = [n for n, (t, w) in enumerate(zip(texts, split)) if not _is_long(t, w, long_text, long_word)]
                columns: list[list] = [[] for _ in fields]
                codec.learn(set().union(*(split[n] for n in keep)))
                get = codec.known.__getitem__
                for n in keep:
                    found = [x for x in map(get, split[n]) if x[0]]
                    spelt = " ".join([x[1] for x in found])
                    decoded = " ".join([x[2] for x in found]) if plain else codec.decode([int(i) for i in spelt.split()])
                    values = (sum([x[0] for x in found]), _sha(spelt), _sha(decoded)) if digests else ([int(i) for i in spelt.split()], decoded)
                    for column, value in zip(columns, values):
                        column.append(value)
                codec.age()
                yield _batch([part.column("id").take(pa.array(keep, pa.int64())), *columns], ["id", *fields], digests)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(path)
        for batch in batches:
            for i, h1, h2, text in zip(*(batch.column(c).to_pylist() for c in ("id", "h1", "h2", "text"))):
                if _is_long(text, split_words(text), long_text, long_word):
                    parts = list(codec.units(text, long_text, long_word)) or [("words", -1, "")]
                    n = len(parts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i] * n, batch.column("id").type), pa.array([h1] * n, pa.int64()), pa.array([h2] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([p[1] for p in parts], pa.int32()), pa.array([p[2] for p in parts], pa.string())],
                        ["id", "h1", "h2", "part", "piece", "unit"],
                    )

    def encode_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(path)
        for batch in batches:
            out = []
            for piece, unit in zip(batch.column("piece").to_pylist(), batch.column("unit").to_pylist()):
                if piece >= 0:
                    out.append(codec.tokenize(unit))
                else:
                    out.append(codec.ids_of(split_words(unit)))
            keep = ["id", "h1", "h2", "part", "piece", "copies"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.list_(pa.int32()))], [*keep, "ids"])

    def assemble(table: pa.Table) -> pa.Table:
        codec = Codec.load(path)
        table = table.sort_by("part")
        total, leaves, last = [], [], -1
        for piece, ids in zip(table.column("piece").to_pylist(), table.column("ids").to_pylist()):
            if piece != last:
                total += codec.concatenate(leaves)
                leaves, last = [], piece
            if piece < 0:
                total += ids
            else:
                leaves.append(ids)
        total += codec.concatenate(leaves)
        decoded = codec.decode(total)
        values = [len(total), _sha(" ".join([codec.spelt[i] for i in total])), _sha(decoded)] if digests else [total, decoded]
        one = pa.Table.from_batches([_batch([table.column("id").slice(0, 1).combine_chunks(), *([v] for v in values)], ["id", *fields], digests)])
        return one.take(pa.array([0] * table.column("copies")[0].as_py()))

    whole = rows.select("id", "text").mapInArrow(short, out_schema)
    # equal rows are one here, told apart by 96 bits of hashes that don't change when a task runs again
    keyed = rows.where(F.length("text") > min(long_text, long_word)).select("id", "text", F.xxhash64("id", "text").alias("h1"), F.hash("text", "id").alias("h2"))
    parts = keyed.mapInArrow(cut, f"id {id_type}, h1 long, h2 int, part int, piece int, unit string")
    parts = parts.groupBy("h1", "h2", "part").agg(F.first("id").alias("id"), F.first("piece").alias("piece"), F.first("unit").alias("unit"), F.count(F.lit(1)).alias("copies"))
    coded = parts.mapInArrow(encode_units, f"id {id_type}, h1 long, h2 int, part int, piece int, copies long, ids array<int>")
    return whole.unionByName(coded.groupBy("h1", "h2").applyInArrow(assemble, out_schema)).withColumnRenamed("id", id_col)


def _batch(columns: list, names: list[str], digests: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string()] if digests else [pa.list_(pa.int32()), pa.string()]
    return pa.RecordBatch.from_arrays([columns[0], *(pa.array(c, k) for c, k in zip(columns[1:], kinds))], names)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the text that each array of ids stands for; a null array gives null."""

    def run(ids: pd.Series) -> pd.Series:
        codec = Codec.load(path)
        return ids.map(lambda x: None if x is None else codec.decode([int(i) for i in x]))

    return df.withColumn(out_col, F.pandas_udf(run, "string")(ids_col))

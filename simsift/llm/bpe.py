"""BPE encoding by tree concatenation, and decoding.

A long text is cut in halves, down to leaves that are encoded on their own, and neighbours are joined
again: around each join a window is re-encoded, and grown until its ids meet those of both sides.

* Between words of a tokenizer that drops white space (found by a probe, `drops_space`), a window that
  reaches white space on both sides always agrees, so a piece keeps its first and last partial word as
  text until a neighbour completes it. Pieces form a monoid: joining them in any tree gives the same ids.
* Inside one unsplit run (a pre-token longer than LEAF) the window is a few ids on each side, doubled
  until its first id is the left side's and some later id starts where the right side has the same id. A
  sequence of ids is the encoding of a run just if every two neighbours are the encoding of their own
  text; as the shared ids are part of both encodings, every pair in the joined sequence has that property.

Texts beyond LONG characters are cut into pieces in Spark, so their parts are encoded by several tasks;
shorter ones are encoded where they are read. A run without white space beyond RUN characters is cut again:
its pre-tokens are dealt out in batches, and a long pre-token in leaves, whose ids are joined in a tree by
the growing window. Encodings of words are kept in a bounded table per worker.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, stored, table

#: Characters of the leaves of the tree, of the pieces that Spark deals out, and from which on it does.
LEAF, PIECE, LONG = 2048, 32_768, 65_536
#: Bytes of an unsplit run from which on its pieces are encoded by several tasks.
RUN = 65_536
#: Words whose ids a worker remembers; beyond that, the first half stays, as frequent words come early.
REMEMBERED = 400_000
#: Ids on each side of a join that are encoded again at first.
WINDOW = 4


# The steps before the model of a lower-casing word tokenizer, for which plain words are cut here.
_NORMALIZER = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same split, for words of printable ASCII and Latin-1 letters in lower case only.
_PLAIN = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[!-/:-@\[-`{-~]+")
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: Bytes that the byte-level alphabet does not show as the character of that number.
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class _Known(dict):
    """Ids of words; a new word is encoded when it is asked for."""

    def __init__(self, encode: Callable[[bytes], bytes], items: Iterable = ()) -> None:
        super().__init__(items)
        self.encode = encode

    def __missing__(self, word: bytes) -> bytes:
        self[word] = ids = self.encode(word)
        return ids


class Encoder:
    """Ids of texts as the tokenizers library gives them, without special tokens being added."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        self.tk.no_truncation()
        self.tk.no_padding()
        self.words = _Known(self._word)
        self.names = [self.tk.id_to_token(i) for i in range(self.tk.get_vocab_size(with_added_tokens=True))]
        special = sorted((t.content for t in self.tk.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        one = [self._direct([w])[0] for w in ("a", "b.", "c", " ", "a \n b.\tc ")]
        self.plain = self._cuts_plain_words()
        self.drops_space = not one[3] and one[0] + one[1] + one[2] == one[4]

    def _direct(self, texts: list[str]) -> list[bytes]:
        found = self.tk.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _cuts_plain_words(self) -> bool:
        steps = json.loads(self.tk.to_str())
        normalizers = [n["type"] for n in (steps["normalizer"] or {}).get("normalizers", [])]
        cuts = (steps["pre_tokenizer"] or {}).get("pretokenizers", [])
        if normalizers != _NORMALIZER or [c["type"] for c in cuts] != ["Split", "ByteLevel"] or steps["model"]["type"] != "BPE":
            return False
        return cuts[0]["pattern"] == {"Regex": _SPLIT} and cuts[0]["invert"] and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]

    def _plain_word(self, word: str) -> bytes | None:
        """Ids by the model alone, for a word whose normal form and pre-tokens are plain to see; None for others."""
        if not self.plain:
            return None
        if word.isascii() and word.isalpha():
            pieces = [word.lower()]
        elif _PLAIN.fullmatch(word) and "<|" not in word:
            pieces = [p if p.isascii() else p.encode().decode("latin-1").translate(_BYTES) for p in _PIECES.findall(word.lower())]
        else:
            return None
        tokenize = self.tk.model.tokenize
        ids = [t.id for p in pieces for t in tokenize(p)]
        return struct.pack(f"<{len(ids)}I", *ids)

    # -- one unsplit run ---------------------------------------------------------------------

    def _run(self, piece: str) -> list[tuple[int, int]]:
        """(id, characters) of a pre-token, by tree concatenation."""
        if len(piece) <= LEAF:
            return self._leaf(piece)
        half = len(piece) // 2
        return self._join(piece, half, self._run(piece[:half]), self._run(piece[half:]))

    def _leaf(self, piece: str) -> list[tuple[int, int]]:
        if piece:
            suffix = self.tk.model.end_of_word_suffix or ""
            out = []
            for t in self.tk.model.tokenize(piece):
                value = t.value
                ends = suffix and value.endswith(suffix)
                out.append((t.id, len(value) - len(suffix) if ends else len(value)))
            return out
        return []

    def join_leaves(self, texts: list[str], ids: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
        """(id, characters) of a pre-token from those of its leaves in order."""
        while len(ids) > 1:
            pairs = range(0, len(ids), 2)
            ids = [self._join(texts[i] + texts[i + 1], len(texts[i]), ids[i], ids[i + 1]) if i + 1 < len(ids) else ids[i] for i in pairs]
            texts = ["".join(texts[i : i + 2]) for i in pairs]
        return ids[0]

    def pretokens(self, word: str) -> Iterator[str | int]:
        """Pre-tokens of a word in the model's alphabet, and ids of its added tokens."""
        at = 0
        cuts = [(m.start(), m.end()) for m in self.special.finditer(word)] if self.special else []
        for s, e in [*cuts, (len(word), len(word))]:
            if s > at:
                yield from (p for p, _ in self.tk.pre_tokenizer.pre_tokenize_str(self.tk.normalizer.normalize_str(word[at:s])))
            if e > s:
                yield self.tk.token_to_id(word[s:e])
            at = e

    def _join(self, piece: str, half: int, left: list[tuple[int, int]], right: list[tuple[int, int]]) -> list[tuple[int, int]]:
        size = WINDOW
        while True:
            a, b = min(size, len(left)), min(size, len(right))
            start, stop = half - sum(n for _, n in left[-a:]), half + sum(n for _, n in right[:b])
            window = self._run(piece[start:stop]) if stop - start <= LEAF else self._whole(piece[start:stop])
            begins = a == len(left) or (a > 1 and window[0] == left[-a])
            if begins and b == len(right):
                return left[: len(left) - a] + window
            if begins:
                starts, at = {}, half
                for k, (i, n) in enumerate(right[:b]):
                    starts[at] = (k, i, n)
                    at += n
                at = start
                for j, (i, n) in enumerate(window[:-1]):  # the last id of the window takes its end for the end of a word
                    k = starts.get(at)
                    if k and k[1:] == (i, n):
                        return left[: len(left) - a] + window[:j] + right[k[0] :]
                    at += n
            size *= 2

    def _whole(self, piece: str) -> list[tuple[int, int]]:
        suffix = self.tk.model.end_of_word_suffix or ""
        return [(t.id, len(t.value.removesuffix(suffix)) if suffix else len(t.value)) for t in self.tk.model.tokenize(piece)]

    def _long_word(self, word: str) -> bytes:
        """A word beyond LEAF: added tokens first, then normalised pre-tokens, each as a run."""
        out = []
        for piece in self.pretokens(word):
            out += [piece] if isinstance(piece, int) else [i for i, _ in self._run(piece)]
        return np.array(out, "<u4").tobytes()

    # -- texts -------------------------------------------------------------------------------

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if len(word) > LEAF:
            return self._long_word(text)
        ids = self._plain_word(text)
        return self._direct([text])[0] if ids is None else ids

    def forget(self) -> None:
        if len(self.words) > REMEMBERED:
            self.words = _Known(self._word, islice(self.words.items(), REMEMBERED // 2))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.drops_space:
            return self._direct(texts)
        self.forget()
        get = self.words.__getitem__
        return [b"".join(map(get, x.encode().split())) for x in texts]

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4").tolist()
        if self.tk.decoder is None:  # the library joins the tokens by spaces then
            return " ".join(map(self.names.__getitem__, numbers))
        return self.tk.decode(numbers, skip_special_tokens=False)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


@dataclass
class Part:
    """A piece of a text. Without white space: only head, the whole piece. Else the ids of its whole words, between
    its first and last partial words."""

    head: bytes
    ids: bytes = b""
    tail: bytes | None = None


def encode_part(text: str, enc: Encoder) -> Part:
    body = text.encode()
    words = body.split()
    if len(words) < 2 and not re.search(rb"[\x20\x09-\x0d]", body):
        return Part(body)
    head = b"" if body[:1].isspace() else words.pop(0)
    tail = b"" if body[-1:].isspace() or not words else words.pop()
    return Part(head, b"".join(map(enc.words.__getitem__, words)), tail)


def join_parts(a: Part, b: Part, enc: Encoder) -> Part:
    if a.tail is None:
        return Part(a.head + b.head, b.ids, b.tail)
    if b.tail is None:
        return Part(a.head, a.ids, a.tail + b.head)
    return Part(a.head, a.ids + enc.encode([(a.tail + b.head).decode()])[0] + b.ids, b.tail)


def tree(parts: list[Part], enc: Encoder) -> bytes:
    """Ids of a text from its parts in order: neighbours are joined in pairs until one part is left."""
    while len(parts) > 1:
        parts = [join_parts(*parts[i : i + 2], enc) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    whole = parts[0]
    return b"".join(enc.encode([whole.head.decode()]) + [whole.ids] + enc.encode([(whole.tail or b"").decode()]))


def _direct(path: str, back: bool) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                b = batch.slice(i, 256)
                ids = enc.encode([x or "" for x in b.column(1).to_pylist()])
                out = [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(out + [pa.array(map(enc.decode, ids), pa.string())] * back, names=["row", "n_tokens", "ids"] + ["decoded"] * back)

    return run


def _parts(path: str) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            found = [encode_part(x, enc) for x in b.column(3).to_pylist()]
            enc.forget()
            arrays = [pa.array([getattr(p, k) for p in found], pa.binary()) for k in ("head", "ids", "tail")]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *arrays], names=["key", "row", "part", "head", "ids", "tail"])

    return run


def segments(parts: list[Part], enc: Encoder, run: int) -> list[bytes | str]:
    """A text's parts in order as ids, and as text where an unsplit run is longer than `run` bytes."""
    long, size = False, 0
    for p in parts:
        long |= size + len(p.head) > run
        size = size + len(p.head) if p.tail is None else len(p.tail)
    if not long and size <= run:
        return [tree(parts, enc)]
    out: list[bytes | str] = [b""]

    def word(pieces: list[bytes]) -> None:
        whole = b"".join(pieces)
        if len(whole) > run:
            out.extend((whole.decode(), b""))
        else:
            out[-1] += enc.encode([whole.decode()])[0]

    open_: list[bytes] = []
    for p in parts:
        open_.append(p.head)
        if p.tail is not None:
            word(open_)
            out[-1] += p.ids
            open_ = [p.tail]
    word(open_)
    return out


def _segments(path: str, run: int) -> Callable:
    names = ["key", "row", "seq", "cut", "ids", "run"]

    def make(rows: pa.Table) -> pa.Table:
        enc = encoder(path)
        rows = rows.combine_chunks().sort_by("part")
        columns = [rows[c].to_pylist() for c in ("head", "ids", "tail")]
        found = segments([Part(*x) for x in zip(*columns, strict=True)], enc, run)
        n = len(found)
        own = pa.concat_arrays([rows["row"].slice(0, 1).combine_chunks(), pa.nulls(n - 1, rows["row"].type)])
        ids, text = ([x if isinstance(x, t) else None for x in found] for t in (bytes, str))
        return pa.Table.from_arrays([pa.array([rows["key"][0].as_py()] * n, pa.int64()), own, pa.array(range(n), pa.int32()), pa.array([n > 1] * n), pa.array(ids, pa.binary()), pa.array(text, pa.string())], names=names)

    return make


_LEAF_ROW = "key long, seq int, unit int, leaf int, text string, added int"


def _leaves(path: str, piece: int) -> Callable:
    """Rows of an unsplit run: added tokens, batches of short pre-tokens (a space between), and leaves of long ones."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for key, seq, word in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                rows, batch, size = [], [], 0
                for p in [*enc.pretokens(word), None]:
                    if batch and (not isinstance(p, str) or size + len(p) > piece):
                        rows.append((-1, " ".join(batch), None))
                        batch, size = [], 0
                    if isinstance(p, int):
                        rows.append((-1, None, p))
                    elif p is not None and len(p) > piece:
                        rows += [(k, p[i : i + piece], None) for k, i in enumerate(range(0, len(p), piece))]
                    elif p is not None:
                        batch.append(p)
                        size += len(p)
                leaf, text, added = zip(*rows, strict=True) if rows else ((), (), ())
                unit = np.cumsum([k <= 0 for k in leaf]) if rows else []
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * n, pa.int64()), pa.array([seq] * n, pa.int32()), pa.array(unit, pa.int32()), pa.array(leaf, pa.int32()), pa.array(text, pa.string()), pa.array(added, pa.int32())],
                    names=["key", "seq", "unit", "leaf", "text", "added"],
                )

    return run


def _encode_leaves(path: str) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            ids, lengths = [], []
            for leaf, text, added in zip(*(b.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
                found = [(added, 0)] if added is not None else enc._run(text) if leaf >= 0 else [t for p in text.split(" ") for t in enc._run(p)]
                ids.append(np.array([t[0] for t in found], "<u4").tobytes())
                lengths.append(np.array([t[1] for t in found], "<u4").tobytes())
            text = [t if k >= 0 else None for k, t in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(text, pa.string()), pa.array(ids, pa.binary()), pa.array(lengths, pa.binary())], names=["key", "seq", "unit", "leaf", "text", "ids", "lengths"])

    return run


def _output(row: pa.Array, ids: list[bytes], enc: Encoder, back: bool) -> pa.Table:
    out = [row, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
    return pa.Table.from_arrays(out + [pa.array(map(enc.decode, ids), pa.string())] * back, names=["row", "n_tokens", "ids"] + ["decoded"] * back)


def _whole(path: str, back: bool) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _output(b.column(0), b.column(1).to_pylist(), encoder(path), back).to_batches()

    return run


def _trees(path: str, back: bool) -> Callable:
    """A text from its segments and leaves."""

    def run(rows: pa.Table) -> pa.Table:
        enc = encoder(path)
        rows = rows.combine_chunks().sort_by([("seq", "ascending"), ("unit", "ascending"), ("leaf", "ascending")])
        out, texts, leaves = [], [], []

        def close() -> None:
            if leaves:
                out.append(np.array([i for i, _ in enc.join_leaves(texts, leaves)], "<u4").tobytes())
                texts.clear()
                leaves.clear()

        for leaf, text, ids, lengths in zip(*(rows[c].to_pylist() for c in ("leaf", "text", "ids", "lengths")), strict=True):
            if leaf <= 0:
                close()
            if leaf < 0:
                out.append(ids)
            else:
                texts.append(text)
                leaves.append(list(zip(np.frombuffer(ids, "<u4").tolist(), np.frombuffer(lengths, "<u4").tolist(), strict=True)))
        close()
        return _output(rows["row"].slice(0, 1).combine_chunks(), [b"".join(out)], enc, back)

    return run


def encode_texts(docs: DataFrame, tokenizer: str, text_col: str = "text", decoded: bool = True, long: int = LONG, piece: int = PIECE) -> DataFrame:
    """docs with n_tokens, ids (binary, little-endian unsigned 32-bit) and, if wanted, decoded.

    ids are those of the tokenizers library for the file `tokenizer` without special tokens being added, truncation
    and padding; decoded is the library's decoding of them, special tokens kept. A null text counts as empty: no ids,
    an empty decoding. Columns of docs with the added names are replaced; repeated rows stay repeated; an empty table
    gives an empty result. The text column itself is kept like any other.
    """
    names = ["n_tokens", "ids", "decoded"][: 2 + decoded]
    own = [c for c in docs.columns if c.lower() not in names]
    rows = docs.select(F.struct(*own).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["row"].dataType
    schema = T.StructType([T.StructField("row", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    if decoded:
        schema = schema.add("decoded", T.StringType())
    size = F.length("text")
    short = rows.where(size <= long).mapInArrow(_direct(tokenizer, decoded), schema)
    pieces = rows.where(size > long).withColumn("key", F.monotonically_increasing_id())
    pieces = pieces.select("key", "row", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))).alias("part", "piece"))
    pieces = pieces.select("key", F.when(F.col("part") == 0, F.col("row")).alias("row"), "part", "piece")
    parts = T.StructType([T.StructField("key", T.LongType()), T.StructField("row", kind), T.StructField("part", T.IntegerType())])
    for c in ("head", "ids", "tail"):
        parts = parts.add(c, T.BinaryType())
    n = partitions(docs.sparkSession)
    done = pieces.repartition(n, "key", "part").mapInArrow(_parts(tokenizer), parts)
    segment = T.StructType([T.StructField("key", T.LongType()), T.StructField("row", kind), T.StructField("seq", T.IntegerType()), T.StructField("cut", T.BooleanType())])
    segment = segment.add("ids", T.BinaryType()).add("run", T.StringType())
    found = stored(done.groupBy("key").applyInArrow(_segments(tokenizer, RUN), segment), "bpe-segments")
    whole = found.where("not cut").select("row", "ids").mapInArrow(_whole(tokenizer, decoded), schema)
    leaves = found.where("run is not null").select("key", "seq", "run").mapInArrow(_leaves(tokenizer, piece), _LEAF_ROW).repartition(n, "key", "seq", "unit", "leaf")
    leaves = leaves.mapInArrow(_encode_leaves(tokenizer), "key long, seq int, unit int, leaf int, text string, ids binary, lengths binary")
    rest = found.where("cut and run is null").select("key", "row", "seq", F.lit(0).alias("unit"), F.lit(-1).alias("leaf"), "ids")
    joined = rest.unionByName(leaves, allowMissingColumns=True).groupBy("key").applyInArrow(_trees(tokenizer, decoded), schema)
    return short.unionByName(whole).unionByName(joined).select("row.*", *names)


def bpe_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    return digests(docs, "body", public_tokenizers.path("word_bpe_49k.json"))


def digests(docs: DataFrame, text_col: str, tokenizer: str) -> DataFrame:
    coded = encode_texts(docs, tokenizer, text_col)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

"""SentencePiece encoding and decoding on the tokenizers library (operator 7).

The model's protobuf is parsed here (no SentencePiece code runs), and its normaliser, metaspace marker, piece scores
and byte fallback are rebuilt as a tokenizers pipeline: a Unigram model from unigram scores, or, for a model of type
BPE, merges ranked by the scores. Batches are encoded by the library's own threads. `parity` compares ids with the
SentencePiece library; tests hold it on whole tables.

Defined results: a null text has null ids, an empty one no ids. Rows are independent; ties, repeated rows and empty
tables need no rule. encode() adds its columns after those of the input, in place of columns of these names.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from histlake.llm.common import lean, table

MODEL = os.environ.get("HISTLAKE_SP_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARK = "▁"
#: Characters that are cut together, within a text too, and words (and their characters) whose ids a worker remembers
#: besides those of the part at hand. They bound what a worker holds; results are the same with any.
BATCH_CHARS = 200_000
MOST_WORDS = 200_000
MOST_CHARS = 4_000_000
CUTS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
EDGE = re.compile(f"[^{MARK}](?={MARK})")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: integers of varints, bytes of all else."""

    def varint(i: int) -> tuple[int, int]:
        x = s = 0
        while True:
            b = data[i]
            x, s, i = x | (b & 127) << s, s + 7, i + 1
            if b < 128:
                return x, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        else:
            n, i = varint(i) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], i)
            value, i = data[i : i + n], i + n
        yield tag >> 3, value


class Model:
    """What encoding needs of a model file. Numbers of fields are those of the public message definition."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normalizer = {}, {}
        for n, v in fields(data):
            if n == 1:
                p = dict(fields(v))
                self.pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif n == 2:
                trainer = dict(fields(v))
            elif n == 3:
                normalizer = dict(fields(v))
        self.kind, self.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        self.charsmap, self.dummy_prefix = normalizer.get(2, b""), bool(normalizer.get(3, 1))
        self.squeeze, self.escape = bool(normalizer.get(4, 1)), bool(normalizer.get(5, 1))
        self.suffix = bool(trainer.get(24, 0))
        self.unk = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        if self.kind not in (UNIGRAM, BPE) or self.suffix:
            raise ValueError("only unigram and BPE models with the marker before words are supported")

    def splittable(self) -> bool:
        """No piece goes on past a marker, so texts may be cut before each run of them."""
        return not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER))


def merges(model: Model) -> list[tuple[str, str]]:
    """Each pair of pieces that makes a piece, best score first; pairs of one piece stay together."""
    vocab = {p for p, _, kind in model.pieces if kind in (NORMAL, USER)}
    ranked = sorted(((-s, i, p) for i, (p, s, kind) in enumerate(model.pieces) if kind == NORMAL and len(p) > 1))
    return [(p[:k], p[k:]) for _, _, p in ranked for k in range(1, len(p)) if p[:k] in vocab and p[k:] in vocab]


def build(model: Model):
    from tokenizers import AddedToken, Regex, Tokenizer, models, normalizers, pre_tokenizers

    if model.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab, merges(model), unk_token=model.pieces[model.unk][0], fuse_unk=True, byte_fallback=model.byte_fallback, cache_capacity=0)
    else:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unk, byte_fallback=model.byte_fallback)
    t = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Replace(Regex(r"\A(?=[\s\S])"), " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    if model.splittable():
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    users = [AddedToken(p, normalized=True) for p, _, kind in model.pieces if kind == USER]
    if users:
        t.add_tokens(users)
    return t


class Codec:
    def __init__(self, path: str):
        from tokenizers import normalizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        # A task is given one core, not all of the machine; idle threads wait busily, and each has an allocator of its own.
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        with open(path, "rb") as f:
            self.model = Model(f.read())
        self.words = None
        if self.model.splittable() and not any(kind == USER for _, _, kind in self.model.pieces):
            self.plain = build(self.model)
            self.plain.normalizer, self.plain.pre_tokenizer = normalizers.Sequence([]), None
            self.forget()
        self.bytes = {i: int(p[3:5], 16) for i, (p, _, kind) in enumerate(self.model.pieces) if kind == BYTE}
        self.texts = ["" if kind in (CONTROL, UNUSED) else " ⁇ " if kind == UNKNOWN else p for p, _, kind in self.model.pieces]

    @cached_property
    def tokenizer(self):
        """That of whole texts, which most models need for nothing."""
        return build(self.model)

    def normalised(self, text: str) -> str:
        if self.model.charsmap or self.model.squeeze:
            return self.tokenizer.normalizer.normalize_str(text)
        text = " " + text if self.model.dummy_prefix and text else text
        return text.replace(" ", MARK) if self.model.escape else text

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids in a row, how many each text has, and whether they decode to its normalised form. Where no piece
        goes past a marker, texts are cut there, and only words not met before go to the library, in batches that it
        deals to its threads."""
        if self.words is None:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            same = [self.raw(i) == self.normalised(x) for i, x in zip(ids, texts, strict=True)]
            return np.fromiter(chain.from_iterable(ids), np.int32), np.array([len(i) for i in ids], np.int64), np.array(same, bool)
        flat, sizes, bad = [np.empty(0, np.int32)], np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for first, held in self.cut(texts):
            at = self.learn(list(chain.from_iterable(held)))
            flat.append(self.ids(at))
            edges = np.cumsum([0, *map(len, held)])
            sizes[first : first + len(held)] += np.diff(np.r_[0, np.cumsum(self.length[at])][edges])
            bad[first : first + len(held)] += np.diff(np.r_[0, np.cumsum(~self.good[at])][edges])
        return np.concatenate(flat), sizes, bad == 0

    def cut(self, texts: list[str]) -> Iterator[tuple[int, list[list[str]]]]:
        """Words of each text, of about BATCH_CHARS at a time, with the place of the first text; what is left of a text
        comes with the next ones."""
        held, chars, first = [], 0, 0
        for i, text in enumerate(texts):
            text, start = self.normalised(text), 0
            while True:
                edge = EDGE.search(text, start + max(0, BATCH_CHARS - chars - 1))
                end = edge.end() if edge else len(text)
                held.append(CUTS.findall(text, start, end))
                chars, start = chars + end - start, end
                if chars >= BATCH_CHARS:
                    yield first, held
                    held, chars, first = [], 0, i if start < len(text) else i + 1
                if start >= len(text):
                    break
        if held:
            yield first, held

    def learn(self, parts: list[str]) -> np.ndarray:
        """Places of parts among the words remembered. Where new ones would pass a bound, those used most since the last
        time stay, up to half of each bound."""
        new = [p for p in set(parts) if p not in self.words]
        if len(self.words) + len(new) > MOST_WORDS or self.chars + sum(map(len, new)) > MOST_CHARS:
            names, order = list(self.words), np.argsort(-self.uses, kind="stable")[: MOST_WORDS // 2]
            self.forget(names, order[np.cumsum([len(names[i]) for i in order]) <= MOST_CHARS // 2])
            new = [p for p in set(parts) if p not in self.words]
        ids = [e.ids for e in self.plain.encode_batch_fast(new, add_special_tokens=False)]
        n = np.array([len(i) for i in ids], np.int64)
        self.start = np.r_[self.start, len(self.pool) + np.cumsum(n) - n]
        self.length = np.r_[self.length, n]
        self.good = np.r_[self.good, np.array([self.raw(i) == p for p, i in zip(new, ids, strict=True)], bool)]
        self.pool = np.r_[self.pool, np.fromiter(chain.from_iterable(ids), np.int32)]
        self.words.update(zip(new, range(len(self.words), len(self.words) + len(new)), strict=True))
        self.chars += sum(map(len, new))
        at = np.fromiter(map(self.words.__getitem__, parts), np.int64, len(parts))
        self.uses = np.r_[self.uses, np.zeros(len(new), np.int64)] + np.bincount(at, minlength=len(self.words))
        return at

    def ids(self, at: np.ndarray) -> np.ndarray:
        """Ids of word after word: each place is its word's first, plus its distance from there."""
        n = self.length[at]
        ends = np.cumsum(n)
        return self.pool[np.repeat(self.start[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]

    def forget(self, names: list[str] = (), kept: np.ndarray = ()) -> None:
        """All words but those at these places of names."""
        if len(kept):
            self.pool, self.length, self.good = self.ids(kept), self.length[kept], self.good[kept]
        else:
            self.pool, self.length, self.good = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, bool)
        self.start, self.uses = np.cumsum(self.length) - self.length, np.zeros(len(kept), np.int64)
        self.words = {names[i]: k for k, i in enumerate(kept)}
        self.chars = sum(map(len, self.words))

    def encode(self, texts: list[str]) -> list[list[int]]:
        flat, sizes, _ = self.encode_flat(texts)
        return [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] if len(sizes) else []

    def raw(self, ids: list[int]) -> str:
        """The normalised text of ids."""
        if not self.bytes or self.bytes.keys().isdisjoint(ids):
            text = "".join([self.texts[i] for i in ids])
        else:
            out, run = [], bytearray()
            for i in ids:
                if i in self.bytes:
                    run.append(self.bytes[i])
                    continue
                if run:
                    out.append(run.decode(errors="replace"))
                    run = bytearray()
                out.append(self.texts[i])
            text = "".join([*out, run.decode(errors="replace")])
        return text

    def decode(self, ids: list[int]) -> str:
        text = self.raw(ids)
        text = text.replace(MARK, " ") if self.model.escape else text
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


@lru_cache(4)
def codec(path: str) -> Codec:
    """One per worker process and model."""
    return Codec(path)


def parity(path: str, texts: list[str]) -> list[int]:
    """Places of texts whose ids are not those of the SentencePiece library."""
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=path).encode(texts, num_threads=1)
    return [i for i, (a, b) in enumerate(zip(codec(path).encode(texts), theirs, strict=True)) if a != b]


def encode(df: DataFrame, path: str = MODEL, text: str = "text") -> DataFrame:
    """df with token_ids, n_tokens, and round_trip: whether the ids decode to the text as the model normalises
    it. One pass, no shuffle."""
    new = [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    kept = [f for f in df.schema.fields if f.name not in {x.name for x in new}]
    schema = T.StructType([*kept, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                texts = part[text].to_pylist()
                there = np.array([x is not None for x in texts], bool)
                flat, sizes, same = c.encode_flat([x for x in texts if x is not None])
                n = np.zeros(len(texts), np.int64)
                n[there] = sizes
                good = np.zeros(len(texts), bool)
                good[there] = same
                offsets = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32), mask=np.r_[~there, False])
                cols = {f.name: part[f.name] for f in kept}
                cols["token_ids"] = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))
                cols["n_tokens"] = pa.array(n, mask=~there)
                cols["round_trip"] = pa.array(good, mask=~there)
                yield pa.RecordBatch.from_pydict(cols)
        if c.words is not None:
            c.forget()

    return df.mapInArrow(lean(run), schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs).select("doc_id", "token_ids", "n_tokens", "round_trip")

"""SentencePiece models on the tokenizers library: encoding, decoding, and parity with the sentencepiece library.

The model's protobuf is parsed here. From it the normaliser, the metaspace marker, byte fallback and either unigram scores or
BPE merges are rebuilt. Batches are encoded on several threads.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import md5
from pathlib import Path
from struct import unpack_from

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

MARK = "▁"
# Fixed values of the format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
KEPT = 500_000  # words whose ids a worker keeps


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes | float]]:
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
        elif wire == 1:
            yield number, unpack_from("<d", data, at)[0]
            at += 8
        elif wire == 2:
            n = varint()
            yield number, data[at : at + n]
            at += n
        elif wire == 5:
            yield number, unpack_from("<f", data, at)[0]
            at += 4
        else:
            raise ValueError(f"wire type {wire} in a SentencePiece model")


@dataclass
class Spec:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)  # text, score, kind
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True  # removes extra white space
    escape: bool = True
    suffix: bool = False  # the marker stands behind words

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def parse(model: bytes) -> Spec:
    spec = Spec()
    for number, value in _fields(model):
        if number == 1:
            own = dict(_fields(value))
            spec.pieces.append((own.get(1, b"").decode(), own.get(2, 0.0), own.get(3, NORMAL)))
        elif number == 2:
            own = dict(_fields(value))
            spec.kind, spec.byte_fallback, spec.suffix = own.get(3, UNIGRAM), bool(own.get(35, 0)), bool(own.get(24, 0))
        elif number == 3:
            own = dict(_fields(value))
            spec.charsmap, spec.dummy_prefix, spec.squeeze, spec.escape = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1)), bool(own.get(5, 1))
    return spec


def _merges(spec: Spec) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best score first; pairs of one piece in order of their parts."""
    place = {text: i for i, (text, _, kind) in enumerate(spec.pieces) if kind in (NORMAL, USER)}
    found = []
    for text, i in place.items():
        for k in range(1, len(text)):
            if text[:k] in place and text[k:] in place:
                found.append((-spec.pieces[i][1], i, place[text[:k]], place[text[k:]], text[:k], text[k:]))
    return [(a, b) for *_, a, b in sorted(found)]


def can_cut(spec: Spec) -> bool:
    """Whether no piece goes on from another character to the marker; then texts can be cut before markers."""
    return not any(re.search(f"[^{MARK}]{MARK}", text) for text, _, kind in spec.pieces if kind in (NORMAL, USER))


def build(spec: Spec) -> Tokenizer:
    if spec.suffix or not spec.escape:
        raise ValueError("models that mark word ends or don't escape white space aren't supported")
    if spec.kind == BPE:
        vocab = {text: i for i, (text, _, _) in enumerate(spec.pieces)}
        model = models.BPE(vocab, _merges(spec), unk_token=spec.pieces[spec.unknown][0], fuse_unk=True, byte_fallback=spec.byte_fallback)
    elif spec.kind == UNIGRAM:
        model = models.Unigram([(text, score) for text, score, _ in spec.pieces], spec.unknown, spec.byte_fallback)
    else:
        raise ValueError(f"model type {spec.kind} isn't supported")
    tokenizer = Tokenizer(model)
    tokenizer.add_tokens([AddedToken(text, normalized=True) for text, _, kind in spec.pieces if kind == USER])  # matched first
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.squeeze:
        steps += [normalizers.Replace(Regex(" +"), " "), normalizers.Strip()]
    steps += [normalizers.Prepend(MARK)] if spec.dummy_prefix else []
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if can_cut(spec):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    ends = [decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *ends])
    return tokenizer


def normalised(text: str, spec: Spec) -> str:
    """What decoding gives back, for models without a character map."""
    return re.sub(" +", " ", text).strip(" ") if spec.squeeze else text


Encoded = tuple[list[np.ndarray], list[bool | None], list[bool | None], list[str]]  # ids, round trip, parity, decoded text


class _Spelling:
    """What ids spell, to compare with the normalised text. Models with a character map can't be compared."""

    def __init__(self, spec: Spec):
        self.pieces = [bytes.fromhex(text[3:5]) if kind == BYTE else text.replace(MARK, " ").encode() for text, _, kind in spec.pieces]
        self.skip, self.mapped = int(spec.dummy_prefix), bool(spec.charsmap)

    def right(self, ids: list[int], text: str) -> bool | None:
        return None if self.mapped else b"".join(map(self.pieces.__getitem__, ids))[self.skip :] == text.encode()


class WordEncoder:
    """Encodes texts word by word, as no piece crosses a marker; words that are new in a batch go to the library together.

    Each new word's ids are compared with those of the reference, if there is one, and with its spelling, once. odd holds the words
    that the reference encodes otherwise, misspelt those that aren't spelt by their ids, changed those that decode to another text.
    """

    def __init__(self, spec: Spec, reference, threads: int):
        self.spec, self.reference, self.threads, self.tokenizer, self.spelling = spec, reference, threads, build(spec), _Spelling(spec)
        self.cut = re.compile(f"{MARK}+[^{MARK}]*").findall
        one = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.blank = {MARK: np.array(one("a ")[len(one("a")) :], np.int32).tobytes()}  # no text is just this word
        self.known: dict[str, bytes] = dict(self.blank)
        self.odd: set[str] = set()
        self.misspelt: set[str] = set()
        self.changed: dict[str, str] = {}

    @staticmethod
    def fits(spec: Spec) -> bool:
        return can_cut(spec) and spec.dummy_prefix and not spec.charsmap and all(kind != USER for _, _, kind in spec.pieces)

    def learn(self, new: list[str]) -> None:
        """The words are laid end to end in one text for each thread; each token knows the word that it is of."""
        solid, blank = [w for w in new if w.strip(MARK)], [w for w in new if not w.strip(MARK)]  # markers alone would run into the next word
        share = max(1, -(-len(solid) // self.threads))
        parts = [solid[k : k + share] for k in range(0, len(solid), share)] + [[w] for w in blank]
        found: dict[str, list[int]] = {}
        for words, e in zip(parts, self.tokenizer.encode_batch(["".join(p).replace(MARK, " ")[1:] for p in parts], add_special_tokens=False), strict=True):
            ids = e.ids
            at = [*np.flatnonzero(np.diff(np.array(e.word_ids), prepend=-1)).tolist(), len(ids)]
            if len(at) != len(words) + 1:
                raise ValueError("words were cut otherwise than expected")
            found.update((w, ids[at[k] : at[k + 1]]) for k, w in enumerate(words))
        texts = [w.replace(MARK, " ")[1:] for w in found]
        if self.reference:
            for w, ids in zip(list(found), self.reference.encode(texts, num_threads=self.threads), strict=True):
                if ids != found[w]:
                    self.odd.add(w)
        self.misspelt.update(w for w, text in zip(found, texts, strict=True) if not self.spelling.right(found[w], text))
        for w, text, back in zip(found, texts, self.tokenizer.decode_batch(list(found.values()), skip_special_tokens=False), strict=True):
            if back != text:
                self.changed[w] = back
        self.known.update((w, np.array(ids, np.int32).tobytes()) for w, ids in found.items())

    def decoded(self, words: list[str], text: str) -> str:
        """Each word is decoded once, when it is new; a text whose words all come back comes back itself, markers as spaces."""
        if not self.changed or self.changed.keys().isdisjoint(words):
            return text.replace(MARK, " ")
        return "".join(" " + self.changed.get(w, w.replace(MARK, " ")[1:]) for w in words)[1:]

    def encode(self, texts: list[str]) -> Encoded:
        plain = [normalised(t, self.spec) for t in texts]
        cut = [self.cut(MARK + t.replace(" ", MARK)) if t else [] for t in plain]
        if len(self.known) > KEPT:
            self.known = dict(self.blank)
        if new := [w for w in set().union(*cut) if w not in self.known]:
            self.learn(new)
        none = lambda bad, words: not bad or bad.isdisjoint(words)
        same = [None if self.reference is None else none(self.odd, words) for words in cut]
        trip = [none(self.misspelt, words) and MARK not in t for words, t in zip(cut, plain, strict=True)]
        return [np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.int32) for words in cut], trip, same, [self.decoded(words, t) for words, t in zip(cut, plain, strict=True)]


class TextEncoder:
    """Encodes whole texts, for models whose pieces may cross markers or that map characters."""

    def __init__(self, spec: Spec, reference, threads: int):
        self.spec, self.reference, self.threads, self.tokenizer, self.spelling = spec, reference, threads, build(spec), _Spelling(spec)

    def encode(self, texts: list[str]) -> Encoded:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        same: list[bool | None] = [None] * len(ids)
        if self.reference is not None:
            right = self.reference.encode(texts, num_threads=self.threads)
            same = [a == b for a, b in zip(ids, right, strict=True)]
        trip = [self.spelling.right(x, normalised(t, self.spec)) for x, t in zip(ids, texts, strict=True)]
        return [np.array(x, np.int32) for x in ids], trip, same, self.tokenizer.decode_batch(ids, skip_special_tokens=False)


_ENCODERS: dict[tuple, WordEncoder | TextEncoder] = {}  # of this worker; the words of one task serve the next


def _encoder(model: bytes, parity: bool, threads: int) -> WordEncoder | TextEncoder:
    key = (hash(model), parity, threads)
    if key not in _ENCODERS:
        spec, reference = parse(model), None
        if parity:
            import sentencepiece

            reference = sentencepiece.SentencePieceProcessor(model_proto=model)
        _ENCODERS.clear()
        _ENCODERS[key] = (WordEncoder if WordEncoder.fits(spec) else TextEncoder)(spec, reference, threads)
    return _ENCODERS[key]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", parity: bool = True, threads: int = 2, batch: int = 256) -> DataFrame:
    """(id, ids, n_tokens, round_trip, same, n_decoded, decoded_md5) for each row of docs.

    n_decoded and decoded_md5: code points and MD5 (of UTF-8) of the text that the ids decode to; null for a null text.

    round_trip: the pieces of ids spell the normalised text (null if the model has a character map); false for a text that itself
    holds the marker, which comes back as a space. same: the sentencepiece library
    gives the same ids for every word of the text, or for the whole text if words can't be told apart (null with parity off); ids are
    always those of the model rebuilt here.
    A null text has null ids and 0 tokens, an empty one has no ids. Rows that repeat an id and null ids come back one by one. An
    empty table gives an empty result. The model file is read by the driver and sent to executors.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("round_trip", pa.bool_()), ("same", pa.bool_()), ("n_decoded", pa.int64()), ("decoded_md5", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        encoder = _encoder(sent.value, parity, threads)
        gc.disable()  # what lives long are bytes, and nothing is part of a cycle
        try:
            for rows in batches:
                for at in range(0, rows.num_rows, batch):
                    part = rows.slice(at, batch)
                    texts = part.column(1).to_pylist()
                    none = [t is None for t in texts]
                    ids, trip, same, back = encoder.encode([t or "" for t in texts])
                    ends = np.cumsum([0, *map(len, ids)])
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *ids])), mask=pa.array(none))
                    sizes, digests = [len(t) for t in back], [md5(t.encode()).hexdigest() for t in back]
                    trip, same, sizes, digests = ([None if n else x for n, x in zip(none, c, strict=True)] for c in (trip, same, sizes, digests))
                    yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(np.diff(ends), pa.int64()), pa.array(trip, pa.bool_()), pa.array(same, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], schema=schema)
        finally:
            gc.enable()

    two = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return two.mapInArrow(run, "id long, ids array<int>, n_tokens long, round_trip boolean, same boolean, n_decoded long, decoded_md5 string").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids", batch: int = 256) -> DataFrame:
    """(id, text) for each row of encoded; null ids give a null text, empty ids the empty text.

    Rows that repeat an id and null ids come back one by one; an empty table gives an empty result; very long lists are decoded as a whole.
    """
    sent = encoded.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = build(parse(sent.value))
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                ids = part.column(1).to_pylist()
                texts = tokenizer.decode_batch([x or [] for x in ids], skip_special_tokens=False)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if x is None else t for x, t in zip(ids, texts, strict=True)], pa.string())], names=["id", "text"])

    two = encoded.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{ids_col}`").alias("ids"))
    return two.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)

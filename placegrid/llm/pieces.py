"""SentencePiece BPE encoding and decoding over a merge-type prefix table.

In byte-pair merging by piece score every prefix of a text has exactly one last token. The table holds, for each
prefix, the length of that token: of the pieces that end there (found by an Aho-Corasick automaton) it is the one whose
predecessor - the last token of the prefix before it - it is compatible with, that is, merging the two pieces' text
gives back the two pieces. Ids are then read off backwards. The work is linear in the text whatever its length.

The vocabulary file is read through the sentencepiece library's model message and only as data. Texts are cut before
each run of word marks, which no piece reaches across (checked when the model is loaded), and a bounded memo keeps the
ids of short cuts already seen.

Defined results: null and empty texts have no ids and decode to the empty string; characters outside the vocabulary
become byte pieces. Input columns called `ids` or `decoded` are replaced, all others are carried along.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import chain

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from placegrid.llm.common import add_columns, texts

SPACE = "▁"
MEMO, MEMO_CHARS = 300_000, 48  # entries in each of two generations, and the longest text kept
PAIRS = 200_000  # pairs of pieces whose compatibility is remembered
# piece kinds of the model message
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def read_model(blob: bytes):
    """(pieces as (text, score, kind), settings of the normalizer) of a serialised model."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(blob)
    norm = model.normalizer_spec
    if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or not norm.escape_whitespaces:
        raise ValueError("only BPE models without a character map, with escaped spaces, are read")
    pieces = [(p.piece, p.score, p.type) for p in model.pieces]
    if any(k in (USER, UNUSED) for _, _, k in pieces) or sum(k == BYTE for _, _, k in pieces) != 256:
        raise ValueError("models with user-defined or unused pieces, or without all byte pieces, are not read")
    return pieces, {"prefix": norm.add_dummy_prefix, "squeeze": norm.remove_extra_whitespaces,
                    "unknown": model.trainer_spec.unk_surface}


class Memo(dict):
    """Ids of cuts already seen. When it is full, it starts anew and fetches from the generation before what comes back."""

    def __init__(self, compute) -> None:
        super().__init__()
        self.compute, self.aged = compute, {}

    def __missing__(self, cut: str) -> tuple[int, ...]:
        ids = self.aged.get(cut) or tuple(self.compute(cut))
        if len(cut) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.aged = dict(self)
                self.clear()
            self[cut] = ids
        return ids


class Pieces:
    def __init__(self, blob: bytes) -> None:
        self.pieces, self.settings = read_model(blob)
        if self.settings["squeeze"]:
            raise ValueError("models that squeeze white space are not read")
        self.id_of = {p: i for i, (p, _, k) in enumerate(self.pieces) if k == NORMAL}
        self.score = {p: self.pieces[i][1] for p, i in self.id_of.items()}
        self.byte_id = {int(p[1:-1], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == BYTE}
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id_of)
        self.cuts = re.compile("(?s) +[^ ]*|[^ ]+") if not crossing else re.compile("(?s).+")
        self.matches = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            if self._merge(p) == [p]:  # other pieces never come out of the merging
                self.matches.add_word(p, (len(p), i))
        self.matches.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.memo = Memo(self._cut_ids)
        surfaces = {BYTE: lambda p: bytes([int(p[1:-1], 16)]), CONTROL: lambda p: b"",
                    UNKNOWN: lambda p: self.settings["unknown"].encode()}
        self.controls = {i for i, (_, _, k) in enumerate(self.pieces) if k == CONTROL}
        self.surface = [surfaces.get(k, lambda p: p.replace(SPACE, " ").encode())(p) for p, _, k in self.pieces]

    def _merge(self, text: str) -> list[str]:
        """The merging itself, for texts as short as two pieces: best score first, then leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for j in range(len(parts) - 1):
                s = self.score.get(parts[j] + parts[j + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, j
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging the text of two tokens gives back the two; remembered."""
        a, b = self.pieces[left][0], self.pieces[right][0]
        if len(self.compatible) >= PAIRS:
            self.compatible.clear()
        fits = self.compatible[left, right] = self._merge(a + b) == [a, b]
        return fits

    def _cut_ids(self, text: str) -> list[int]:
        """Ids of one cut: fill the table of last tokens forwards, read it backwards."""
        text = text.replace(" ", SPACE)
        n, known, fits = len(text), self.compatible, self._fits
        last, size = [-1] * n, [1] * n  # per prefix: id of its last token (-1: an unknown character) and its length
        for end, (length, piece) in self.matches.iter(text):
            if last[end] < 0:
                left = last[end - length] if length <= end else -1
                ok = left < 0 or known.get((left, piece))
                if ok or ok is None and fits(left, piece):
                    last[end], size[end] = piece, length
        out, at = [], n - 1
        while at >= 0:
            if last[at] >= 0:
                out.append(last[at])
            else:
                out.extend(self.byte_id[b] for b in reversed(text[at].encode()))
            at -= size[at]
        out.reverse()
        return out

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        # cuts keep their plain spaces until they are looked at, so that most of those remembered take a byte a character
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if self.settings["prefix"]:
            text = " " + text
        return list(chain.from_iterable(map(self.memo.__getitem__, self.cuts.findall(text))))

    def decode(self, ids: Sequence[int]) -> str:
        """Text of ids: the space of the dummy prefix goes; bytes that form no character become U+FFFD each."""
        runs, cut = [[]], False
        if self.controls.isdisjoint(ids):
            runs, ids = [ids], ()
        for i in ids:
            if i in self.controls:
                cut = True
            elif cut and runs[-1]:
                runs.append([i])
                cut = False
            else:
                runs[-1].append(i)
                cut = False
        head = runs[0][:1]
        raw = [b"".join(map(self.surface.__getitem__, r)) for r in runs]
        if self.settings["prefix"] and head and self.pieces[head[0]][2] == NORMAL and raw[0].startswith(b" "):
            raw[0] = raw[0][1:]
        return "".join(map(_lenient, raw))


def _lenient(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[at:at + e.start].decode())
            out.append("�")
            at += e.start + 1
    return "".join(out)


def load_blob(path: str) -> bytes:
    """The vocabulary file, read where the query is built; `path` is a parameter of the caller."""
    with open(path, "rb") as f:
        return f.read()


def tokenized(docs: DataFrame, blob: bytes, keep_text: bool = True) -> DataFrame:
    """`docs` with `ids` (array of int) and `decoded` (the text that the ids give back)."""
    shared = docs.sparkSession.sparkContext.broadcast(blob)

    def start():
        model = Pieces(shared.value)

        def one(batch):
            ids = [model.encode(t.decode(errors="replace")) if t else [] for t in texts(batch)]
            return [ids, [model.decode(i) for i in ids]]

        return one

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return add_columns(docs, fields, start, drop=[] if keep_text else ["text"])


def token_digests(docs: DataFrame, blob: bytes) -> DataFrame:
    """`docs` less its text, with n_tokens and the SHA-256 of the ids and of the decoded text (both in lower-case hex).

    The same encoding and decoding as `tokenized`; the ids stay in the task.
    """
    from hashlib import sha256

    shared = docs.sparkSession.sparkContext.broadcast(blob)

    def start():
        model = Pieces(shared.value)
        name = [str(i) for i in range(len(model.pieces))].__getitem__

        def one(batch):
            n, of_ids, of_text = [], [], []
            for t in texts(batch):
                ids = model.encode(t.decode(errors="replace")) if t else []
                n.append(len(ids))
                of_ids.append(sha256(",".join(map(name, ids)).encode()).hexdigest())
                of_text.append(sha256(model.decode(ids).encode()).hexdigest())
            return [n, of_ids, of_text]

        return one

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType())]
    return add_columns(docs, fields, start, drop=["text"])

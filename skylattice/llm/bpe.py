"""Byte-pair encoding with word ends, by a backtracking encoder, and decoding by an offset table (operator 13).

A vocabulary file (``tokenizers`` JSON, model BPE over bytes) names the merges in order.  The merges are never replayed:

1. *Pair-compatibility table.*  Two tokens may stand side by side if the merges, run over both together, would never have joined across
   their border.  Undoing the later of the two border merges, again and again, shows it; each pair is decided once while it is remembered.
   A token that the merges do not give for its own bytes is taken out the same way.
2. *Longest matches.*  An Aho-Corasick automaton over all tokens runs once over the new words of a batch and leaves the longest token
   that begins at each place.  A word's last byte has symbols of its own where the file has a suffix for word ends, so no match crosses words.
3. *Backtracking.*  From left to right the longest token that is compatible with the one before is taken; where none is, the place is
   dead and the token before gives way to its longest shorter prefix.  A place dies at most once, so time is linear in the word, and the first way through is
   the result of the merges, because only one sequence of tokens is compatible throughout.

Texts become words by the file's own rules.  Plain texts (all characters in ``_PLAIN``) go through the same rules by the ``regex`` module; all others
through the file's normalizer and pre-tokenizer, as the Unicode versions of the two differ elsewhere.  A word is encoded once while a task remembers it.

Decoding joins the strings of the tokens by one space, as a file without decoder does: all strings stand in one buffer, and an
offset table tells where each begins.  Ids that no token has are left out.

A null text counts as empty and has no ids.  Literals of the file's added tokens in a text are one id each.  Rows are encoded one by one,
whatever ids repeat or are null; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import list_array, small_batches, texts_of

#: Words, and pairs of tokens, that a task remembers before it starts anew.
WORDS, PAIRS = 500_000, 2_000_000
#: Characters on whose classes, case and composition all Unicode versions since 9 agree; no combining ones.
_PLAIN = regex.compile(r"[\x00-˿Α-ΡΣ-ώЀ-҂Ҋ-ԯ‐-‧‰-⁞€、-〩ぁ-ゖァ-ヺ一-龥가-힣\U0001F300-\U0001F5FF\U0001F600-\U0001F64F]*")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: printable ones for themselves, the others from 256 on in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """Tokens as strings over 512 symbols: bytes 0..255 inside a word, 256..511 as its last one."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _byte_letters()
        self.suffix = model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("ignore_merges") or spec.get("decoder"):
            raise ValueError("the file must hold a plain BPE model without decoder")

        def symbols(token: str) -> str:
            last = bool(self.suffix) and token.endswith(self.suffix)
            coded = [letters[c] for c in (token[: -len(self.suffix)] if last else token)]
            return "".join(map(chr, coded[:-1])) + chr(coded[-1] + 256 * last)

        self.strings = {i: t for t, i in model["vocab"].items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.literals = {a["content"]: a["id"] for a in spec["added_tokens"]}
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in spec["added_tokens"]):
            raise ValueError("added tokens must stand for themselves alone")
        size = max(self.strings) + 1
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size  # merges in order; -1: a single symbol
        self.merged: dict[tuple[int, int], int] = {}
        ids = model["vocab"]
        for order, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            whole = ids[a + b]
            if self.rank[whole] >= 0:
                raise ValueError(f"two merges give {a + b!r}")
            self.rank[whole], self.left[whole], self.right[whole] = order, ids[a], ids[b]
            self.merged[ids[a], ids[b]] = whole
        self.pairs: dict[tuple[int, int], bool] = {}
        sound = [True] * size  # parts come before wholes
        for whole in sorted((i for i in ids.values() if self.rank[i] >= 0), key=self.rank.__getitem__):
            a, b = self.left[whole], self.right[whole]
            sound[whole] = sound[a] and sound[b] and self._apart(a, b, self.rank[whole])
        coded = {symbols(t): i for t, i in ids.items() if sound[i]}
        self.size, self.shorter = [0] * size, [-1] * size
        self.automaton = ahocorasick.Automaton()
        for token, i in coded.items():
            self.automaton.add_word(token, i)
            self.size[i] = len(token)
            self.shorter[i] = next((coded[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in coded), -1)
        self.automaton.make_automaton()

    def _apart(self, a: int, b: int, before: int | None = None) -> bool:
        """Whether the merges (of an order less than ``before``) leave the border between the bytes of two tokens alone."""
        while True:
            whole = self.merged.get((a, b))
            if whole is not None and (before is None or self.rank[whole] < before):
                return False
            if self.rank[a] > self.rank[b]:
                before, a = self.rank[a], self.right[a]  # of equal merges the left one came first, so an equal one is too late here
            elif self.rank[b] >= 0:
                before, b = self.rank[b] + 1, self.left[b]  # and one on the left of the border was in time here
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self._apart(a, b)
        return known

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The token ids of each word (none of them empty)."""
        coded = [w.encode("utf-8") for w in words]
        text = "".join(c[:-1].decode("latin-1") + chr(c[-1] + (256 if self.suffix else 0)) for c in coded) if self.suffix else "".join(c.decode("latin-1") + "￿" for c in coded)
        longest = [-1] * len(text)
        size = self.size
        for end, token in self.automaton.iter(text):
            longest[end + 1 - size[token]] = token  # ends grow, so the last one written is the longest
        out, at = [], 0
        for c in coded:
            out.append(self._tokens(longest, at, at + len(c)))
            at += len(c) + (not self.suffix)
        return out

    def _tokens(self, longest: list[int], at: int, end: int) -> list[int]:
        size, shorter, out, dead = self.size, self.shorter, [], set()
        token = longest[at]
        while at < end:
            while token >= 0 and (at + size[token] in dead or (out and not self.compatible(out[-1], token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                token = longest[at] if at < end else -1
            elif out:
                dead.add(at)
                token = out.pop()
                at -= size[token]
            else:
                raise ValueError("a byte without token")
        return out


class Encoder:
    """Texts to ids; keeps the words it has seen."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.vocabulary = Vocabulary(path)
        self.rules = Tokenizer.from_file(path)
        self.literal = re.compile("|".join(map(re.escape, sorted(self.vocabulary.literals, key=len, reverse=True))) or r"(?!)")
        self.pattern = self._pattern(path)
        self.forget()

    @staticmethod
    def _pattern(path: str) -> regex.Pattern | None:
        """The expression of words, if the file's rules are: compose, white space to blanks, lower case, matches of one expression as bytes."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normal, cut = ((spec[k] or {}).get(v, []) for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        plain = [n["type"] for n in normal] == ["NFC", "Replace", "Lowercase"] and normal[1]["pattern"] == {"Regex": r"\s+"} and normal[1]["content"] == " "
        if not plain or [p["type"] for p in cut] != ["Split", "ByteLevel"] or (cut[0]["behavior"], cut[0]["invert"]) != ("Removed", True) or cut[1]["use_regex"] or cut[1]["add_prefix_space"]:
            return None
        return regex.compile(cut[0]["pattern"]["Regex"])

    def forget(self) -> None:
        self.numbers: dict[str, int] = {literal: k for k, literal in enumerate(self.vocabulary.literals)}
        self.parts: list[np.ndarray] = [np.array(list(self.vocabulary.literals.values()), np.int32)]
        self.counts: list[int] = [1] * len(self.numbers)

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text without literals, in slices that end in a blank, across which no rule reaches."""
        at = 0
        while at < len(text):
            upto = len(text) if len(text) - at <= 1 << 20 else max(text.rfind(" ", at, at + (1 << 20)), text.rfind("\n", at, at + (1 << 20))) + 1 or next((m.end() for m in re.compile("[ \n]").finditer(text, at)), len(text))
            part = text[at:upto]
            at = upto
            if self.pattern and (part.isascii() or _PLAIN.fullmatch(part)):
                yield self.pattern.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
            else:
                part = self.rules.normalizer.normalize_str(part) if self.rules.normalizer else part
                yield [part[a:b] for _, (a, b) in self.rules.pre_tokenizer.pre_tokenize_str(part)]

    def _pieces(self, text: str) -> Iterator[list[str]]:
        at = 0
        for found in self.literal.finditer(text):
            yield from self.words(text[at : found.start()])
            yield [found.group()]
            at = found.end()
        yield from self.words(text[at:])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each text has."""
        if len(self.numbers) > WORDS:
            self.forget()
        number, per = [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            for words in self._pieces(text or ""):
                new = [w for w in dict.fromkeys(words) if w not in self.numbers]
                if new:
                    got = self.vocabulary.encode_words(new)
                    self.numbers.update(zip(new, range(len(self.counts), len(self.counts) + len(new)), strict=True))
                    self.counts.extend(map(len, got))
                    self.parts.append(np.array([i for ids in got for i in ids], np.int32))
                number.append(np.array([*map(self.numbers.__getitem__, words)], np.int64))
                per[k] += len(words)
        ids, count = np.concatenate(self.parts), np.array(self.counts, np.int64)
        self.parts = [ids]
        first = np.cumsum(count) - count
        word = np.concatenate([np.empty(0, np.int64), *number])
        n = count[word]
        upto = np.cumsum(n)
        return ids[np.repeat(first[word] - upto + n, n) + np.arange(int(n.sum()))], np.diff(np.concatenate([[0], upto])[np.concatenate([[0], np.cumsum(per)])])


_ENCODERS: dict[str, Encoder] = {}


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and ids, the token ids of the whole text by the file at ``path``, without special tokens around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:  # one for each Python worker, kept between its tasks
            _ENCODERS[path] = Encoder(path)
        for batch in small_batches(batches, "text"):
            ids, counts = _ENCODERS[path].encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), list_array(ids, counts, pa.int32())], names=["doc_id", "ids"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


class Decoder:
    """Ids to texts: every token's bytes and a blank stand in one buffer, token i at ``begin[i]:begin[i + 1]``."""

    def __init__(self, strings: dict[int, str]):
        size = max(strings) + 1
        tokens = [(strings[i] + " ").encode() if i in strings else b"" for i in range(size)]
        self.begin = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The text of each slice of ``ids``."""
        known = (ids >= 0) & (ids < len(self.begin) - 1)
        safe = np.where(known, ids, 0)
        length = np.where(known, self.begin[safe + 1] - self.begin[safe], 0)
        upto = np.concatenate([[0], np.cumsum(length)])
        data = self.data[np.repeat(self.begin[safe] - upto[:-1], length) + np.arange(upto[-1])]
        edges = upto[np.concatenate([[0], np.cumsum(counts)])]
        return pa.array([data[a : max(a, b - 1)].tobytes().decode() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.string())


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with the decoded text; null ids give an empty text."""
    decoders: dict[str, Decoder] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = decoders.setdefault(path, Decoder(Vocabulary(path).strings) if path not in _ENCODERS else Decoder(_ENCODERS[path].vocabulary.strings))
        for whole in batches:
            sizes = np.cumsum(whole.column("ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            at = 0
            while at < whole.num_rows:  # about a million ids at a time; a longer row stands alone
                upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + (1 << 20), "right")))
                batch = whole.slice(at, upto - at)
                column = batch.column("ids")
                text = decoder.decode(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column, text], names=["doc_id", "ids", "text"])
                at = upto

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, and sha-256 of the decimal ids joined by one space and of the decoded text."""
    done = decode(encode(docs, path), path)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))

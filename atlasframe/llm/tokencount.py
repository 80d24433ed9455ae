"""Token counts of whole texts by rank-synchronous merging of ragged arrays.

The library that belongs to the vocabulary file normalises and pre-tokenises; the byte-pair merging is
done here, for all new pre-tokens of a batch at once.  Their symbols lie one after another in one array,
with the number of the sequence that each belongs to.  A round finds the lowest rank among each
sequence's adjacent pairs, joins that pair wherever the sequence has it, and looks up ranks again only
beside what was joined.  Sequences without a pair leave the arrays; their surviving symbols are counted.

The library merges one place at a time, lowest rank first, leftmost of equals.  Joining all places of a
pair in one round gives the same as long as no merge that uses the joined symbol ranks before the merge
that made it; where a vocabulary has such a merge, only the leftmost place is joined in that round.

Null texts count as empty and have no tokens; equal and repeated rows give equal counts; an empty table
gives an empty result; texts of any length are counted whole.  Input columns other than the id and the
text are ignored, so their names can't clash.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices
from .packing import _PLAIN, _byte_chars

#: Stretches of text that a worker remembers at most, and their length.
MEMORY, SHORT = 300_000, 64
#: A character for private use, put between stretches; texts may have it.
MARK = "\ue000"
_NONE = np.iinfo(np.int64).max


class PairMerges:
    """The merges of a vocabulary as sorted arrays."""

    def __init__(self, vocabulary: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str = ""):
        self.size = max(vocabulary.values(), default=0) + 1
        pairs = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(merges)}
        keys = np.array([a * self.size + b for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        found = np.array(list(pairs.values()), dtype=np.int64).reshape(-1, 2)[order]
        self.keys, self.ranks = keys[order], found[:, 0]
        self.joined = np.zeros(int(self.ranks.max(initial=-1)) + 1, dtype=np.int64)  # by rank
        self.joined[self.ranks] = found[:, 1]
        first_use = np.full(self.size, _NONE)
        for side in (self.keys // self.size, self.keys % self.size):
            np.minimum.at(first_use, side, self.ranks)
        self.together = first_use[self.joined] > np.arange(len(self.joined))
        letters = {c: i for c, i in vocabulary.items() if len(c) == 1}
        last = {c: vocabulary[c + suffix] for c in (t.removesuffix(suffix) for t in vocabulary if t.endswith(suffix)) if len(c) == 1} if suffix else letters
        self.inside, self.last = self._table(letters), self._table(last)

    @staticmethod
    def _table(ids: dict[str, int]) -> np.ndarray:
        out = np.full(max(map(ord, ids), default=0) + 2, -1, dtype=np.int64)  # the last entry is for all letters beyond
        for c, i in ids.items():
            out[ord(c)] = i
        return out

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or ``_NONE``."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], _NONE) if len(self.keys) else np.full(len(key), _NONE)

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' letters as ids, and the number of each one's word; letters without an id are left out."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        ids = self.inside[np.minimum(letters, len(self.inside) - 1)]
        ends = np.cumsum(sizes)[sizes > 0] - 1
        ids[ends] = self.last[np.minimum(letters[ends], len(self.last) - 1)]
        owner = np.repeat(np.arange(len(words)), sizes)
        return ids[ids >= 0], owner[ids >= 0]

    def count(self, words: list[str]) -> np.ndarray:
        """How many symbols each word has left when nothing can be merged any more."""
        out = np.zeros(len(words), dtype=np.int64)
        ids, owner = self.symbols(words)
        ranks = np.full(len(ids), _NONE)  # of the pair that begins here
        if len(ids) > 1:
            ranks[:-1] = np.where(owner[:-1] == owner[1:], self.rank(ids[:-1], ids[1:]), _NONE)
        while len(ids):
            begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[begins, len(ids)])
            lowest = np.minimum.reduceat(ranks, begins)
            done = lowest == _NONE
            out[owner[begins[done]]] = sizes[done]
            keep = np.repeat(~done, sizes)
            ids, owner, ranks, lowest = ids[keep], owner[keep], ranks[keep], np.repeat(lowest[~done], sizes[~done])
            if not len(ids):
                break
            at = np.flatnonzero(ranks == lowest)
            run = np.r_[True, (np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]])]  # a pair of equal symbols overlaps itself
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            first = np.r_[True, owner[at[1:]] != owner[at[:-1]]]
            at = at[np.where(self.together[lowest[at]], nth % 2 == 0, first)]
            ids[at] = self.joined[lowest[at]]
            ranks[at] = -1  # to be looked up again, as the one before
            before = at[at > 0] - 1
            gone = np.zeros(len(ids), dtype=bool)
            gone[at + 1] = True
            twice = before[gone[before]] - 1  # the symbol before was joined itself: the pair begins one earlier
            ranks[np.r_[before, twice[twice >= 0]]] = -1
            ids, owner, ranks = ids[~gone], owner[~gone], ranks[~gone]
            new = np.flatnonzero(ranks == -1)
            after = np.minimum(new + 1, len(ids) - 1)
            ranks[new] = np.where((owner[after] == owner[new]) & (after > new), self.rank(ids[new], ids[after]), _NONE)
        return out


class TokenCounter:
    """Counts the tokens of texts as the library for the JSON file at ``path`` does."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model = said["model"]
        if model.get("type", "BPE") != "BPE" or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path}: only plain byte-pair vocabularies are counted")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = PairMerges(model["vocab"], pairs, model.get("end_of_word_suffix") or "")
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        special = sorted((t["content"] for t in said["added_tokens"]), key=len, reverse=True)
        self.special = re.compile(f"({'|'.join(map(re.escape, special))})") if special else None
        self.by_blanks = self._drops_blanks(said["pre_tokenizer"])
        self.mark = "".join(self._pre_tokens(MARK))
        self.bytes = _byte_chars()
        letters = "".join(chr(c) for c in range(256) if chr(c).isalpha() and _PLAIN.fullmatch(chr(c)))
        tried = [_PLAIN.fullmatch(s) for s in (letters, "x", "Hello!?", "it'", "a_", "É).", "z" + "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])))]
        self.plain = self.by_blanks and all(self._plain_words(m) == self._pre_tokens(m[0]) for m in tried)
        self.words: dict[str, int] = {}
        self.stretches: dict[str, int] = {}

    def _drops_blanks(self, said: dict) -> bool:
        """Whether pre-tokens are only what a pattern matches, and none holds or touches a space or line end;
        then a text's pre-tokens are those of its stretches between them."""
        split = said.get("pretokenizers", [said])[0]
        if split.get("type") != "Split" or split.get("behavior") != "Removed" or not split.get("invert"):
            return False
        tried = "a b 1 2 ! ? 's é\n\n東 京 . \r\n x"
        return [w for w, _ in self.pre_tokenizer.pre_tokenize_str(tried)] == [w for x in re.split("[ \r\n]", tried) for w, _ in self.pre_tokenizer.pre_tokenize_str(x)]

    def _pre_tokens(self, text: str) -> list[str]:
        shown = self.normalizer.normalize_str(text) if self.normalizer else text
        return [w for w, _ in self.pre_tokenizer.pre_tokenize_str(shown)]

    def _plain_words(self, m: re.Match) -> list[str]:
        word = m[1].lower()
        return [word if word.isascii() else word.encode().decode("latin-1").translate(self.bytes), m[2]][: 2 if m[2] else 1]

    def _cut(self, stretches: list[str]) -> list[tuple[int, list[str]]]:
        """For each stretch, how many special strings it has, and the pre-tokens of the rest.  A stretch of Latin-1
        letters and closing punctuation is cut here, where the library was seen to do likewise; others go through the library all at once, kept apart by a mark that is a pre-token of its own."""
        at_once, alone = [], {}
        for k, s in enumerate(stretches):
            if self.plain and (m := _PLAIN.fullmatch(s)):
                alone[k] = (0, self._plain_words(m))
            elif not self.by_blanks or MARK in s or (self.special and self.special.search(s)):
                parts = self.special.split(s) if self.special else [s]
                alone[k] = (len(parts) // 2, [w for part in parts[::2] for w in self._pre_tokens(part)])
            else:
                at_once.append(s)
        met = iter(self._pre_tokens("".join([f"{s} {MARK} " for s in at_once])))
        return [alone[k] if k in alone else (0, list(iter(met.__next__, self.mark))) for k in range(len(stretches))]

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text; what none of them shares is forgotten afterwards."""
        cut = [t.replace("\n", " ").split(" ") if self.by_blanks else [t] for t in texts]
        unknown = list(set().union(*cut) - self.stretches.keys())
        found = dict(zip(unknown, self._cut(unknown), strict=True))
        new = list({w for _, words in found.values() for w in words} - self.words.keys())
        self.words.update(zip(new, self.merges.count(new).tolist(), strict=True))
        self.stretches.update((s, n + sum(map(self.words.__getitem__, words))) for s, (n, words) in found.items())
        out = [sum(map(self.stretches.__getitem__, c)) for c in cut]
        for memory, added in ((self.words, new), (self.stretches, found)):
            for s in [s for s in added if len(s) > SHORT]:
                del memory[s]
            if len(memory) > MEMORY:
                memory.clear()
        return out


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens and over_limit of every text; ``tokenizer`` is the path of a JSON file."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(tokenizer)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = pa.array(counter.counts(texts), pa.int64())
            sizes = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
            over = pa.array([n > limit for n in counts.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, counts, over], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")

"""Toxicity scores of texts whose words may be disguised.

Disguises are a noisy channel: letters become digits or signs (1d10t), are set apart (i d i o t, i-d-i-o-t), repeated
(idiooot) or masked (id*ot). Each piece of a text with a digit, a sign that can stand for a letter, a separator or a doubled
letter is a character lattice whose edges keep, replace, drop or separate signs at a cost, and the cheapest path under a
trigram model of characters, which counts all texts of the corpus, is what was written (Viterbi over all pairs of signs, as
long as the piece). The plain reading counts too if it differs. Pieces of other plain letters have one path only. Words set
apart by white space are joined where three or more single signs follow each other, or where pieces make up one of the
typical words and the cheapest path joins them; pieces with signs in them are joined with others only if they are single.

The score is a logistic regression on how often a text has each of the words that are typical of toxic texts, disguised or
not. Words are chosen and weights fitted on labelled rows whose crc32(doc_id as text) mod 5 is not 0, at most ``most_rows``
of them by a hash of the id (the bound also lets them be broadcast); equal texts count once for each label. The words are
ranked by distributed counts; the driver gets at most ``most_rows`` rows of word numbers, and the words that three or more
of their toxic rows have, and others seldom.

Null and empty texts have the score of a text without any such word. Repeated rows and ids each get a row. Without
labelled rows, all scores are 0; with one label only, they are its smoothed share. Very long texts and pieces are read
whole. Null labels don't count. An empty table gives no rows.
Columns other than the id and the text, and doc_id and toxic of the labels, are not read.
"""

from __future__ import annotations

import re
import string
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.common import release_worker, saved, ship, text_of, trim_worker, worker_cache

SIGNS = 28  # between words, a to z, any other letter
OTHER = 27
_symbols = np.zeros(256, np.uint8)
_symbols[97:123] = np.arange(1, 27)
_symbols[0xDF:0xF7] = _symbols[0xF8:0x100] = OTHER
LETTERS = " abcdefghijklmnopqrstuvwxyz~"
_bytes = np.frombuffer(f"{LETTERS}\0".encode(), np.uint8)  # -1 is nothing

# Letters that a digit or sign can stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "¢": "c"}
# Letters of other scripts that look like these.
ALIKE = dict(zip("аеорсухіѕԁһјкмтвнαορνικτ", "aeopcyxisdhjkmtbhaopvikt", strict=True))
MASKS = "*#"
MASKED_LETTER = re.compile(r"[*#]")
SEPARATORS = " .-_'’/,·"
SIGNS_AT_ONCE, STEPS_HELD, LONGEST_TAIL, TAILS_KEPT = 1 << 20, 4096, 32, 2000
REPLACED, DROPPED, JOINED, PARTED, REPEATED, DOUBLED, MASKED, UNMASKED = 0.5, 12.0, 0.5, 3.0, 0.5, 8.0, 1.0, 8.0
DOUBLE = re.compile(r"([a-z])\1")
PARTS = re.compile(r"[-'’/.,_]")
EDGE = "".join(c for c in string.punctuation if c not in LEET and c not in MASKS)  # no letter can be meant by these


def count_grams(texts: DataFrame, text_column: str = "text") -> DataFrame:
    """(gram, n): how often each three signs follow each other in all texts, runs of non-letters being one sign."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SIGNS**3, np.int64)
        for batch in batches:
            held = batch["text"].tolist()
            for at in range(0, len(held), 500):
                raw = f" {' '.join(held[at : at + 500])} ".lower().encode("latin-1", "replace")
                s = _symbols[np.frombuffer(raw, np.uint8)]
                s = s[np.append(True, (s[1:] > 0) | (s[:-1] > 0))].astype(np.int32)
                total += np.bincount((s[:-2] * SIGNS + s[1:-1]) * SIGNS + s[2:], minlength=SIGNS**3)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"gram": seen.astype(np.int32), "n": total[seen]})

    own = texts.select(text_of(text_column).alias("text"))
    return own.mapInPandas(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def edges(c: str, same: bool = False, three: bool = False) -> list[tuple[int, float]]:
    """(what is written, cost) for a sign; -1 drops it. same: it follows an equal sign; three: three equal ones in a row."""
    if "a" <= c <= "z":
        return [(LETTERS.index(c), 0.0)] + [(-1, REPEATED if three else DOUBLED)] * same
    if c in LEET:
        return [(LETTERS.index(x), REPLACED) for x in LEET[c]] + [(-1, REPEATED if same else DROPPED)]
    if c in MASKS:
        return [(x, MASKED) for x in range(1, 27)] + [(-1, UNMASKED)]
    if c in SEPARATORS:
        return [(-1, JOINED), (0, PARTED)]
    if c in ALIKE:
        return [(LETTERS.index(ALIKE[c]), 0.0)]
    if c.isalpha():
        return [(OTHER, 0.0)] + [(LETTERS.index(x), REPLACED) for x in base_letter(c)]
    return [(-1, PARTED), (0, PARTED)]


@lru_cache(maxsize=4096)
def base_letter(c: str) -> str:
    """The letter of a to z below a letter's accents; empty if there is none."""
    base = unicodedata.normalize("NFKD", c)[0].lower()
    return base if "a" <= base <= "z" else ""


def least_of_equal(keys: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """The place of the least cost of each key (the first of equals), in the order of keys."""
    order = np.argsort(keys, kind="stable")
    keys, costs = keys[order], costs[order]
    new = np.append(True, keys[1:] != keys[:-1])
    group = np.cumsum(new) - 1
    least = np.flatnonzero(costs == np.minimum.reduceat(costs, np.flatnonzero(new))[group])
    return order[least[np.append(True, np.diff(group[least]) > 0)]]


class Tail:
    """The end of pieces from a masked letter on, solved backwards for all states, as many pieces end alike (***)."""

    def __init__(self, raw: str, steps: np.ndarray, ends: np.ndarray):
        self.choices: list[np.ndarray] = []
        self.edges = [edges(c, i > 0 and raw[i - 1] == c, raw[max(0, i - 2) : i + 1] == 3 * c or raw[i - 1 : i + 2] == 3 * c) for i, c in enumerate(raw)]
        step = steps.reshape(SIGNS, SIGNS, SIGNS)
        costs = ends.reshape(SIGNS, SIGNS)
        for choices in self.edges[::-1]:
            ways = np.empty((SIGNS, SIGNS, len(choices)))
            for k, (code, price) in enumerate(choices):
                ways[:, :, k] = price + (costs if code < 0 else step[:, :, code] + costs[:, code])
                if code == 0:
                    ways[:, 0, k] = price + costs[:, 0]
            self.choices.append(ways.argmin(axis=2).astype(np.uint8).ravel())
            costs = ways.min(axis=2)
        self.costs = costs.ravel()
        self.known: dict[int, str] = {}

    def said(self, state: int) -> str:
        if state in self.known:
            return self.known[state]
        out, start = [], state
        for choices, choice in zip(self.edges, self.choices[::-1], strict=True):
            code, last = choices[choice[state]][0], state % SIGNS
            if code > 0 or code == 0 and last:
                out.append(LETTERS[code])
                state = last * SIGNS + code
        self.known[start] = "".join(out)
        return self.known[start]


class Decoder:
    """Viterbi over the lattices of many pieces at once. The states of all pieces, each the last two letters written, are
    rows of arrays; a step reads the next sign of every piece, and of equal states of a piece the cheapest stays. Ends of
    pieces that begin with a masked letter, where nearly all states are reached, are solved once for all pieces."""

    def __init__(self, grams: dict[int, int]):
        n = np.zeros(SIGNS**3)
        for k, v in grams.items():
            n[k] = v
        n = n.reshape(SIGNS, SIGNS, SIGNS)
        two = n.sum(axis=0)
        one = two.sum(axis=0)
        single = (one + 1) / (one.sum() + SIGNS)
        pair = (two + 20 * single) / (two.sum(axis=1, keepdims=True) + 20)
        after = -np.log((n + 20 * pair[None]) / (n.sum(axis=2, keepdims=True) + 20))
        self.steps = after.copy()
        self.steps[:, 0, :] = -np.log(pair[0])  # a word's first letter
        self.steps = self.steps.reshape(SIGNS * SIGNS, SIGNS)
        self.ends = after[:, :, 0].copy()
        self.ends[:, 0] = 0.0
        self.ends = self.ends.ravel()
        self.tails: dict[str, Tail] = {}

    def decode(self, raw: str) -> str:
        return self.decode_all([raw])[0]

    def decode_all(self, raws: list[str]) -> list[str]:
        """What was written in each: words of a to z between single blanks; ~ for other letters."""
        cut = []
        for raw in raws:
            m = MASKED_LETTER.search(raw)
            cut.append(m.start() if m and len(raw) - m.start() <= LONGEST_TAIL else len(raw))
        heads, tails = [x[:n] for x, n in zip(raws, cut, strict=True)], [self.tail(x[n:]) if n < len(x) else None for x, n in zip(raws, cut, strict=True)]
        out = [tail.said(0).strip() if tail else "" for tail in tails]
        order = sorted((i for i, x in enumerate(heads) if x), key=lambda i: -len(heads[i]))
        at = 0
        while at < len(order):
            longest = len(heads[order[at]])
            to = at + 1
            while to < len(order) and 2 * len(heads[order[to]]) >= longest and (to - at + 1) * longest <= SIGNS_AT_ONCE:
                to += 1
            some = order[at:to]
            for i, said in zip(some, self._cheapest([heads[i] for i in some], [tails[i] for i in some]), strict=True):
                out[i] = said.strip()
            at = to
        return out

    def tail(self, raw: str) -> Tail:
        if raw not in self.tails:
            if len(self.tails) >= TAILS_KEPT:
                self.tails = {}
            self.tails[raw] = Tail(raw, self.steps, self.ends)
        return self.tails[raw]

    def _cheapest(self, raws: list[str], tails: list[Tail | None]) -> list[str]:
        """raws: the longest first; what follows each, if anything."""
        kinds = list(dict.fromkeys(tails))
        ends = np.array([tail.costs if tail else self.ends for tail in kinds])
        number = {tail: i for i, tail in enumerate(kinds)}
        kind = np.array([number[tail] for tail in tails])
        lengths = np.array([len(x) for x in raws])
        starts = np.cumsum(lengths) - lengths
        signs = np.frombuffer("".join(raws).encode("utf-32-le", "surrogatepass"), "<u4")
        known, which = np.unique(signs, return_inverse=True)
        same = np.append(False, signs[1:] == signs[:-1])
        same[starts] = False
        three = same & (np.append(False, same[:-1]) | np.append(same[1:], False))
        lattice = [edges(chr(c), *how) for c in known for how in ((False, False), (True, False), (True, True))]
        first = np.append(0, np.cumsum([len(x) for x in lattice]))
        code, price = (np.array([e[k] for x in lattice for e in x]) for k in (0, 1))
        row = which * 3 + same + three
        alive = len(raws) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")

        word, key, cost = np.arange(len(raws)), np.zeros(len(raws), np.int64), np.zeros(len(raws))
        at, last_key = np.zeros(len(raws), np.int64), np.zeros(len(raws), np.int64)  # of finished pieces: their cheapest state
        said = np.zeros((len(raws), int(lengths[0])), np.uint8)
        backs: list[tuple[np.ndarray, np.ndarray]] = []
        told = 0  # steps whose signs are in said already

        def finish(since: int) -> None:
            best = least_of_equal(word[since:], cost[since:] + ends[kind[word[since:]], key[since:]]) + since
            at[word[best]], last_key[word[best]] = best, key[best]

        for t in range(len(alive)):
            if alive[t] < word[-1] + 1:
                cut = int(np.searchsorted(word, alive[t]))
                finish(cut)
                word, key, cost = word[:cut], key[:cut], cost[:cut]
            sign = row[starts[word] + t]
            edge, many = first[sign], first[sign + 1] - first[sign]
            parent = np.arange(len(word))
            if many.max() > 1:
                parent = np.repeat(parent, many)
                edge = edge[parent] + np.arange(len(parent)) - np.repeat(np.cumsum(many) - many, many)
            written, before = code[edge], key[parent]
            last = before % SIGNS
            stays = (written < 0) | (written == 0) & (last == 0)
            cost = cost[parent] + price[edge] + np.where(stays, 0.0, self.steps[before, np.maximum(written, 0)])
            key, word = np.where(stays, before, last * SIGNS + written), word[parent]
            written = np.where(stays, -1, written)
            if len(word) > alive[t]:
                order = least_of_equal(word * (SIGNS * SIGNS) + key, cost)
                word, key, cost, parent, written = word[order], key[order], cost[order], parent[order], written[order]
            backs.append((parent.astype(np.int32), written.astype(np.int8)))
            if len(raws) == 1 and len(backs) >= STEPS_HELD:
                told = self._tell_settled(backs, said[0], told)
        finish(0)
        for t in range(len(alive) - 1, told - 1, -1):
            parent, written = backs[t - told]
            now = at[: alive[t]]
            said[: alive[t], t] = _bytes[written[now]]
            at[: alive[t]] = parent[now]
        flat, width = said.tobytes(), said.shape[1]
        heads = (flat[i : i + width].replace(b"\0", b"").decode() for i in range(0, len(flat), width))
        return [head + tail.said(state) if tail else head for head, tail, state in zip(heads, tails, last_key.tolist(), strict=True)]

    @staticmethod
    def _tell_settled(backs: list[tuple[np.ndarray, np.ndarray]], said: np.ndarray, told: int) -> int:
        """Writes the steps that all paths of a long piece have in common, and forgets them."""
        states = np.arange(len(backs[-1][0]))
        for t in range(len(backs) - 1, -1, -1):
            states = np.unique(backs[t][0][states])
            if len(states) == 1 and t:
                at = int(states[0])
                for k in range(t - 1, -1, -1):
                    parent, written = backs[k]
                    said[told + k], at = _bytes[written[at]], int(parent[at])
                del backs[:t]
                return told + t
        return told


def is_plain(piece: str) -> bool:
    """Whether a piece's lattice has one path only."""
    return piece.isalpha() and piece.isascii() and not DOUBLE.search(piece)


def strip_and_sort(piece: str) -> tuple[list[str], str]:
    """(words as they are, what must be decoded too) of a piece in lower case."""
    odd = piece.strip(EDGE)
    if is_plain(odd):
        return [odd], ""
    inner = piece.strip(string.punctuation)
    parts = [p for p in PARTS.split(inner) if p]
    plain = parts if all(p.isalpha() for p in parts) else []
    if len(odd) < 2 or odd.isalpha() and not DOUBLE.search(odd) and not any(c in ALIKE or base_letter(c) for c in odd if c > "\x7f"):
        return plain, ""
    return plain, odd


def pieces_of(text: str) -> list[str]:
    """Runs of anything but white space, in lower case and in compatible forms (fullwidth letters become plain)."""
    low = text.lower()
    return (low if low.isascii() else unicodedata.normalize("NFKC", low).lower()).split()


class Reader:
    """The words of texts, restored. Words of short pieces are kept for the next texts, ``most_kept`` at most."""

    def __init__(self, decoder: Decoder, most_kept: int = 150_000, longest_kept: int = 64):
        self.decoder, self.most, self.longest, self.kept = decoder, most_kept, longest_kept, {}

    def restored(self, pieces: set[str]) -> dict[str, list[str]]:
        some = sorted(pieces)
        return {p: said.split() for p, said in zip(some, self.decoder.decode_all(some), strict=True)}

    def words_by_piece(self, pieces: set[str]) -> dict[str, list[str]]:
        """The words of pieces, without those that are one plain word as they stand."""
        out, odd, kept = {}, {}, self.kept
        for p in pieces:
            if p in kept:
                out[p] = kept[p]
            elif not is_plain(p):
                odd[p] = strip_and_sort(p)
        said = self.restored({x for _, x in odd.values() if x})
        for p, (plain, x) in odd.items():
            odd[p] = plain + [w for w in said[x] if w not in plain and LETTERS[OTHER] not in w] if x else plain
        if len(kept) + len(odd) > self.most:
            self.kept = {}
        self.kept.update((p, words) for p, words in odd.items() if len(p) <= self.longest)
        return out | odd

    def words(self, texts: list[str]) -> list[list[str]]:
        """Of each text, to learn from: without words that are joined from longer pieces, and of words with accents only what
        is written, as their other readings may be no words at all."""
        cut = [pieces_of(t) for t in texts]
        known = self.words_by_piece(set().union(*cut))
        for p in known:
            if not p.isascii() and (inner := p.strip(EDGE)).isalpha() and not any(c in ALIKE for c in inner):
                known[p] = [inner]
        runs = [single_runs([(i, p) for i, p in enumerate(c) if len(p) == 1]) for c in cut]
        said = self.restored({r for found in runs for r in found})
        return [[w for p in c for w in known.get(p, (p,))] + [w for r in found for w in said[r]] for c, found in zip(cut, runs, strict=True)]


def single_runs(singles: list[tuple[int, str]]) -> list[str]:
    """Three or more single signs that stand side by side, each run with blanks between."""
    out, a = [], 0
    for b in range(1, len(singles) + 1):
        if b == len(singles) or singles[b][0] != singles[b - 1][0] + 1:
            if b - a > 2:
                out.append(" ".join(p for _, p in singles[a:b]))
            a = b
    return out


def in_chunks(texts: list[str], most: int = 1_000_000) -> Iterator[list[str]]:
    """texts by about ``most`` characters."""
    chunk, n = [], 0
    for t in texts:
        if chunk and n + len(t) > most:
            yield chunk
            chunk, n = [], 0
        chunk.append(t)
        n += len(t)
    if chunk:
        yield chunk


class Scorer:
    """A fitted model; what executors get."""

    def __init__(self, grams: dict[int, int], words: list[str], weights: np.ndarray):
        self.grams, self.words, self.weights, self._reader = grams, words, weights, None

    def __getstate__(self):
        return self.__dict__ | {"_reader": None}

    def reader(self) -> Reader:
        if self._reader is None:
            worker_cache("toxicity", (), dict)  # what earlier stages kept goes
            self._reader = Reader(Decoder(self.grams))
            self._number = {w: i for i, w in enumerate(self.words)}
            self._starts = {w[:n] for w in self.words for n in range(1, len(w) + 1)}
            self._inside = {w[a:b] for w in self.words for a in range(len(w)) for b in range(a, len(w) + 1)}
        return self._reader

    def forget(self) -> None:
        """Leaves this worker's memory to later stages."""
        self._reader = None
        release_worker()

    def hits(self, texts: list[str]) -> list[dict[int, int]]:
        """How often each text has each word, counting words in two or more pieces (st upid)."""
        reader = self.reader()
        number, inside = self._number, self._inside
        cut = [pieces_of(t) for t in texts]
        # Of each piece that matters: the numbers of its words, what it can be a part of a word as, whether it is a single.
        seen: dict[str, tuple[list[int], str | None, bool]] = {}
        pieces = set().union(*cut)
        said = reader.words_by_piece(pieces)
        for piece in pieces:
            words = said.get(piece)
            ids = [number[w] for w in words if w in number] if words is not None else [number[piece]] if piece in number else []
            part = piece if words is None else piece.strip(EDGE)
            if part not in inside or part in number:
                part = None
            if ids or part is not None or len(piece) == 1:
                seen[piece] = ids, part, len(piece) == 1
        get, out, later = seen.get, [], []
        for k, pieces in enumerate(cut):
            some = [(i, x) for i, x in enumerate(map(get, pieces)) if x]
            out.append(Counter(n for _, (ids, _, _) in some for n in ids))
            later += [(k, run, None) for run in single_runs([(i, pieces[i]) for i, x in some if x[2]])]
            later += [(k, parts, whole) for parts, whole in self.joined(some)]
        said = reader.restored({x for _, x, _ in later})
        for k, parts, whole in later:
            if whole is None:
                out[k].update(number[w] for w in said[parts] if w in number)
            elif said[parts] == [whole]:
                out[k][number[whole]] += 1
        return out

    def joined(self, some: list[tuple[int, tuple]]) -> Iterator[tuple[str, str]]:
        """(pieces with blanks between, word) of words in two or more pieces that stand side by side."""
        for a, (_, (_, whole, _)) in enumerate(some):
            if not whole:
                continue
            parts = [whole]
            for b in range(a + 1, len(some)):
                part = some[b][1][1]
                if some[b][0] != some[b - 1][0] + 1 or part is None or whole + part not in self._starts:
                    break
                whole += part
                parts.append(part)
                if whole in self._number and any(len(p) > 1 for p in parts):
                    yield " ".join(parts), whole

    def scores(self, texts: list[str]) -> dict[str, float]:
        """By text; equal ones are scored once."""
        known: dict[str, float] = {}
        for chunk in in_chunks(list(dict.fromkeys(texts))):
            if len(self.weights):
                z = rowwise(self.hits(chunk), len(self.words)) @ self.weights
                known.update(zip(chunk, (1 / (1 + np.exp(-z))).tolist(), strict=True))
            else:
                known.update(dict.fromkeys(chunk, 0.0))
        return known


def rowwise(hits: list[dict[int, int]], words: int) -> np.ndarray:
    """Features: log(1 + count) of each word, of all together, and 1."""
    out = np.zeros((len(hits), words + 2))
    for i, h in enumerate(hits):
        for k, n in h.items():
            out[i, k] = np.log1p(n)
        out[i, words] = np.log1p(sum(h.values()))
    out[:, words + 1] = 1
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the last column's is free of the penalty."""
    w = np.zeros(x.shape[1])
    free = np.full(x.shape[1], penalty)
    free[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(free), x.T @ (y - p) - free * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, least_z: float = 4.0, id_column: str = "doc_id", text_column: str = "text") -> Scorer:
    ship(docs.sparkSession)
    grams = {r[0]: r[1] for r in count_grams(docs, text_column).collect()}  # at most SIGNS ** 3
    known = labels.select(F.col("doc_id").cast("long").alias("k"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("k").isNotNull() & ~held_out(F.col("k"))).distinct()
    known = known.orderBy(F.xxhash64("k"), "k", "toxic").limit(most_rows)
    own = docs.select(F.col(id_column).cast("long").alias("k"), text_of(text_column).alias("text")).join(F.broadcast(known), "k").select("toxic", "text")
    rows = saved(own.withColumn("mark", F.md5("text")).dropDuplicates(["mark", "toxic"]).drop("mark"), "labelled")
    totals = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 and not n0:
        return Scorer(grams, [], np.zeros(0))
    blank = Scorer(grams, [], np.zeros(0))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[str, list[int]] = {}
            at = iter(batch["toxic"])
            for chunk in in_chunks(batch["text"].tolist()):
                for words_of, toxic in zip(blank.reader().words(chunk), at, strict=False):
                    for w in set(words_of):
                        found.setdefault(w, [0, 0])[toxic] += 1
            yield pd.DataFrame([(w, a, b) for w, (a, b) in found.items()], columns=["word", "n0", "n1"])

    counts = rows.mapInPandas(words, "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    share = (F.col("n0") + F.col("n1") + 1.0) / (n0 + n1 + 2)
    gap = (F.col("n1") + share) / (n1 + 1) - (F.col("n0") + share) / (n0 + 1)
    z = gap / F.sqrt(share * (1 - share) * (1 / (n1 + 1) + 1 / (n0 + 1)))
    chosen = counts.withColumn("z", z).where((F.col("z") >= least_z) & (F.col("n1") >= 3))
    lexicon = sorted(r[0] for r in chosen.select("word").collect())
    model = Scorer(grams, lexicon, np.zeros(len(lexicon) + 2))

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hits = [h for chunk in in_chunks(batch["text"].tolist()) for h in model.hits(chunk)]
            yield pd.DataFrame({"toxic": batch["toxic"], "word": [list(h) for h in hits], "n": [list(h.values()) for h in hits]})

    seen = rows.mapInPandas(numbers, "toxic int, word array<int>, n array<int>").collect()  # at most most_rows
    x = rowwise([dict(zip(r.word, r.n, strict=True)) for r in seen], len(lexicon))
    return Scorer(grams, lexicon, fit_logistic(x, np.array([r.toxic for r in seen], float)))


def score_column(model: Scorer, text: Column) -> Column:
    """Equal texts of a batch are scored once."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trim_worker()
        for texts in batches:
            yield texts.map(model.scores(texts.tolist())).astype("float64")
        model.forget()

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """Returns doc_id, held_out, score and predicted, a row for each row of docs."""
    model = fit(docs, labels, id_column=id_column, text_column=text_column, **options)
    doc_id = F.col(id_column).cast("long")
    own = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), score_column(model, text_of(text_column)).alias("score"))
    return own.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """docs without the rows that are predicted to be toxic, in docs' columns."""
    model = fit(docs, labels, id_column=id_column, text_column=text_column, **options)
    return docs.where(score_column(model, text_of(text_column)) < 0.5)

"""SentencePiece encoding and decoding with N-best segmentation.

A text is read with U+2581 for each space and one in front; a segmentation covers it with pieces of the vocabulary,
and its score is the sum of theirs. Characters that no piece covers, line ends and a U+2581 of the text itself among
them, fall back to byte pieces, each at the lowest score less UNKNOWN. Decoding the pieces gives back the exact text.

Best paths come from a forward Viterbi pass over the piece lattice. Its scores are the exact cost to go of a backward
A* search from the end: the search takes complete paths off its agenda in order of score, as many as are asked for.
No piece but runs of U+2581 has that mark after its first character, so a text's lattice falls apart at words, and the
N best segmentations of a text combine those of its words: a heap over the words' losses against their best paths,
in which only the words of the N - 1 smallest first losses can take part. Words repeat, so a bounded table remembers
their best paths; the texts of a batch are put together from it by place, not word by word.

The search keeps a pointer to what follows for each entry, and leaves a place after N paths through it, so a word of
n characters takes memory in proportion to N n, also where it is a whole text without spaces.

Of paths of equal score the best one is the one whose last pieces start first, and the others follow in the order of
the agenda, which depends on the word alone.
Edge cases: a null text stays null in all results; an empty text has no piece and score 0; repeated rows are each
answered; very long words are cut at nothing, the lattice is as long as they are.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.llm.common import pieces as slices
from keystrata.llm.common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NBEST = 4
UNKNOWN = 10.0
MARK = "▁"
#: Words whose best paths a worker remembers, and words whose alternatives it does.
REMEMBERED, ALTERNATIVES_KEPT = 200_000, 20_000


#: Words up to this length, of characters below 256, are solved together; others one by one.
_SOLVED = 64
_MARK_COLUMN = 256


class Vocabulary:
    """The pieces of a model file with their scores, and the byte pieces."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.piece = [model.id_to_piece(i) for i in range(size)]
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.spelled = [bytes([self.of_byte[i]]) if i in self.of_byte else p.replace(MARK, " ").encode() for i, p in enumerate(self.piece)]
        self.id: dict[str, int] = {}
        self.score: dict[str, float] = {}
        for i in range(size):
            # A piece with a mark inside would join words; runs of marks alone are spaces in a row.
            p = self.piece[i]
            if i not in special and i not in self.of_byte and p and (MARK not in p[1:] or not p.strip(MARK)):
                self.id[p], self.score[p] = i, float(model.get_score(i))
        #: Every prefix of a piece; a piece has its number and score, a mere prefix None.
        self.prefix: dict[str, tuple[float, int] | None] = {}
        for p in self.id:
            for k in range(1, len(p)):
                self.prefix.setdefault(p[:k], None)
        self.prefix |= {p: (self.score[p], i) for p, i in self.id.items()}
        self.fallback = min((x for x in self.score.values() if x > -1e8), default=0.0) - UNKNOWN
        if len(self.byte) < 256:
            raise ValueError("the vocabulary has no byte pieces, so not every text can be encoded")
        self.spelled_column = pa.array(self.spelled, pa.binary())
        self._tabulate()
        self.forget()

    def forget(self) -> None:
        """Drops what is remembered: the place of each word in the table of best paths, and alternatives by word."""
        self.known: dict[str, int] = {}
        self.other: dict[tuple[str, int], list] = {}
        #: By place: score, loss of the second best path, where the pieces begin in _pool, and how many they are.
        self._score, self._loss = np.empty(0), np.empty(0)
        self._begin, self._long, self._pool = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def _tabulate(self) -> None:
        """The prefixes as a transition table over the characters below 256 and the mark, for _solved()."""
        column = lambda c: _MARK_COLUMN if c == MARK else ord(c) if c < "\u0100" else -1
        step: dict[tuple[int, int], int] = {}
        scores, ids = [-np.inf, -np.inf], [-1, -1]
        for p, i in self.id.items():
            columns = [column(c) for c in p]
            if min(columns) < 0:
                continue
            node = 1
            for c in columns:
                if (node, c) not in step:
                    step[node, c] = len(scores)
                    scores.append(-np.inf)
                    ids.append(-1)
                node = step[node, c]
            scores[node], ids[node] = self.score[p], i
        self.step = np.zeros((len(scores), _MARK_COLUMN + 1), np.int32)
        for (node, c), to in step.items():
            self.step[node, c] = to
        self.node_score, self.node_id = np.array(scores), np.array(ids, np.int32)
        spelled = [[self.byte[b] for b in c.encode()] for c in [*map(chr, range(256)), MARK]]
        self.byte_count = np.array([len(b) for b in spelled])
        self.byte_pieces = np.array([b + [0] * (3 - len(b)) for b in spelled], np.int32)
        #: What a character without a piece costs, 0 for one that has a piece.
        self.lone = np.array([0.0 if self.prefix.get(c) else self.fallback * len(c.encode()) for c in [*map(chr, range(256)), MARK]])

    # ------------------------------------------------ one word

    def lattice(self, word: str, sign: str | None = None) -> tuple[list[float], list[list[tuple[int, float, tuple[int, ...]]]]]:
        """Forward scores of each place, and for each place the edges that end there: start, score, pieces.

        sign stands for a mark that is a character of the text.
        """
        n = len(word)
        best, into = [-1e300] * (n + 1), [[] for _ in range(n + 1)]
        best[0] = 0.0
        prefix = self.prefix
        for start in range(n):
            base, end = best[start], start + 1
            while end <= n:
                p = word[start:end]
                got = prefix.get(p, 0)
                if got == 0:
                    break
                if got is not None:
                    s, i = got
                    into[end].append((start, s, (i,)))
                    if base + s > best[end]:
                        best[end] = base + s
                end += 1
            c = word[start]
            if prefix.get(c) is None:
                raw = (MARK if c == sign else c).encode("utf-8", "surrogatepass")
                s = self.fallback * len(raw)
                into[start + 1].append((start, s, tuple([self.byte[b] for b in raw])))
                if base + s > best[start + 1]:
                    best[start + 1] = base + s
        return best, into

    def paths(self, word: str, sign: str | None = None, nbest: int | None = None) -> Iterator[tuple[float, tuple[int, ...]]]:
        """Segmentations of a word from the best on, nbest at most: A* from the end, forward scores being exact estimates.

        An entry points to the node that it came from; a node is made when an entry leaves the agenda. Of the first
        nbest paths none needs a place that nbest others have left before.
        """
        best, into = self.lattice(word, sign)
        agenda = [(-best[-1], 0, len(word), 0.0, -1, ())]
        nodes: list[tuple[int, tuple[int, ...]]] = []
        left = [0] * (len(word) + 1)
        count = 0
        while agenda:
            cost, _, place, tail, came, piece = heapq.heappop(agenda)
            if nbest is not None and left[place] >= nbest:
                continue
            left[place] += 1
            if place == 0:
                ids = list(piece)
                while came >= 0:
                    came, piece = nodes[came]
                    ids += piece
                yield -cost, tuple(ids)
                continue
            nodes.append((came, piece))
            here = len(nodes) - 1
            for start, s, piece in into[place]:
                count += 1
                if nbest is None or left[start] < nbest:
                    heapq.heappush(agenda, (-(best[start] + s + tail), count, start, s + tail, here, piece))

    def best_of(self, word: str, sign: str | None = None) -> tuple[float, bytes, float]:
        """Score and pieces of the best path of a word, and the loss of the second best; infinite if there is none.

        The second best path has an edge off the best one; the best path through an edge is a forward score, the
        edge, and a backward score.
        """
        best, into = self.lattice(word, sign)
        place, parts, on = len(word), [], set()
        while place:
            total = best[place]
            start, _, piece = next(e for e in into[place] if best[e[0]] + e[1] == total)
            on.add((start, place))
            parts.append(piece)
            place = start
        loss = float("inf")
        back = [-1e300] * len(best)
        back[-1] = 0.0
        other = -1e300
        for end in range(len(word), 0, -1):
            after = back[end]
            for start, s, _ in into[end]:
                x = s + after
                if x > back[start]:
                    back[start] = x
                if best[start] + x > other and (start, end) not in on:
                    other = best[start] + x
        if other > -1e299:
            loss = best[-1] - other
        return best[-1], np.array([i for piece in reversed(parts) for i in piece], np.int32).tobytes(), loss

    def _solved(self, x: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """best_of() of many words, a place of all of them at a time; the arithmetic is that of lattice().

        x: the columns of their characters, one word after another; long: their lengths. Scores, losses, pieces of
        one word after another, and how many each has.
        """
        n = len(long)
        # A row for each place, so that what is read and written at a place lies together.
        at = np.zeros((n, long.max()), np.int32)
        at[np.arange(at.shape[1]) < long[:, None]] = x
        at = np.ascontiguousarray(at.T)
        most = len(at)
        best = np.full((most + 1, n), -np.inf)
        best[0] = 0.0
        before, via, edges = np.zeros(best.shape, np.int16), np.zeros(best.shape, np.int32), []

        def reach(start: int, end: int, who: np.ndarray, s: np.ndarray, what: np.ndarray) -> None:
            total, old = best[start].take(who) + s, best[end]
            more = np.flatnonzero(total > old.take(who))
            w = who.take(more)
            old[w], before[end][w], via[end][w] = total.take(more), start, what.take(more)
            edges.append((start, end, who, s))

        for start in range(most):
            all_ = who = np.flatnonzero(long > start)
            node, end = np.ones(len(who), np.int32), start
            while len(who):
                node = self.step[node, at[end].take(who)]
                end += 1
                on = np.flatnonzero(node)
                who, node = who.take(on), node.take(on)
                s = self.node_score.take(node)
                piece = np.flatnonzero(s > -np.inf)
                if len(piece):
                    reach(start, end, who.take(piece), s.take(piece), self.node_id.take(node.take(piece)))
                more = np.flatnonzero(long.take(who) > end)
                who, node = who.take(more), node.take(more)
            lone = all_.take(np.flatnonzero(self.lone.take(at[start].take(all_)) < 0))
            if len(lone):
                reach(start, start + 1, lone, self.lone.take(at[start].take(lone)), -1 - at[start].take(lone))
        # Back along the best paths; `to` is where the path's edge from a place ends.
        to, rows, places, kinds = np.zeros(at.shape, np.int16), [], [], []
        who, place = np.arange(n), long.copy()
        while len(who):
            start = before[place, who].astype(np.int64)
            to[start, who] = place
            rows.append(who)
            places.append(place)
            kinds.append(via[place, who])
            on = start > 0
            who, place = who[on], start[on]
        rows, places, kinds = map(np.concatenate, (rows, places, kinds))
        order = np.argsort(rows * (most + 1) + places)
        rows, kinds = rows[order], kinds[order]
        back, other = np.full(best.shape, -np.inf), np.full(n, -np.inf)
        back[long, np.arange(n)] = 0.0
        for start, end, who, s in reversed(edges):
            v = s + back[end].take(who)
            own = back[start]
            own[who] = np.maximum(own.take(who), v)
            off = np.flatnonzero(to[start].take(who) != end)
            w = who.take(off)
            other[w] = np.maximum(other.take(w), best[start].take(w) + v.take(off))
        best = best[long, np.arange(n)]
        loss = np.where(np.isfinite(other), best - other, np.inf)
        # Characters without a piece give the pieces of their bytes.
        many = np.where(kinds < 0, self.byte_count[np.clip(-1 - kinds, 0, _MARK_COLUMN)], 1)
        which = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        kinds, rows = np.repeat(kinds, many), np.repeat(rows, many)
        ids = np.where(kinds < 0, self.byte_pieces[np.clip(-1 - kinds, 0, _MARK_COLUMN), which], kinds)
        return best, loss, ids.astype(np.int32), np.bincount(rows, minlength=n)

    # ------------------------------------------------ texts

    @staticmethod
    def words(text: str) -> tuple[list[str], str | None]:
        """The words of a text with the marks before them, and the sign that stands for a mark of the text itself."""
        sign = None
        if MARK in text:
            sign = next(c for c in map(chr, range(0xE000, 0xE000 + len(text) + 1)) if c not in text)
            text = text.replace(MARK, sign)
        return _split(MARK + text.replace(" ", MARK)), sign

    def _learn(self, words: set[str]) -> None:
        """Solves words that aren't known: together where _solved() can take them, else one by one."""
        fresh = words.difference(self.known)
        if len(self.known) + len(fresh) > REMEMBERED:
            self.forget()
            fresh = words
        fresh = list(fresh)
        if not fresh:
            return
        long = np.fromiter(map(len, fresh), np.int64, len(fresh))
        x = np.frombuffer("".join(fresh).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        x = np.where(x == ord(MARK), _MARK_COLUMN, np.where(x < _MARK_COLUMN, x, _MARK_COLUMN + 1))
        begin = np.cumsum(long) - long
        plain = (long <= _SOLVED) & (np.maximum.reduceat(x, begin) <= _MARK_COLUMN)
        order = np.flatnonzero(plain)
        order = order[np.argsort(long[order], kind="stable")]
        for i in range(0, len(order), 8192):
            some = order[i : i + 8192]
            upto = np.cumsum(long[some])
            own = np.arange(upto[-1]) + np.repeat(begin[some] - upto + long[some], long[some])
            self._keep([fresh[k] for k in some.tolist()], *self._solved(x[own], long[some]))
        odd = [fresh[k] for k in np.flatnonzero(~plain).tolist()]
        if odd:
            self._keep(odd, *self._columns([self.best_of(w) for w in odd]))

    @staticmethod
    def _columns(found: list[tuple[float, bytes, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What best_of() gave for some words, as _solved() gives it."""
        return np.array([f[0] for f in found]), np.array([f[2] for f in found]), np.frombuffer(b"".join([f[1] for f in found]), np.int32), np.array([len(f[1]) >> 2 for f in found])

    def _keep(self, words: list[str], score: np.ndarray, loss: np.ndarray, ids: np.ndarray, long: np.ndarray) -> None:
        at = len(self._score)
        self.known.update(zip(words, range(at, at + len(words)), strict=True))
        self._begin = np.concatenate([self._begin, len(self._pool) + np.cumsum(long) - long])
        self._score, self._loss, self._long, self._pool = (np.concatenate(x) for x in ((self._score, score), (self._loss, loss), (self._long, long), (self._pool, ids)))

    def entry(self, word: str) -> tuple[float, bytes, float]:
        """best_of() of a word that is known, from the table."""
        k = self.known[word]
        return float(self._score[k]), self._pool[self._begin[k] : self._begin[k] + self._long[k]].tobytes(), float(self._loss[k])

    def encode(self, text: str, nbest: int) -> tuple[float, np.ndarray, list[tuple[float, list[tuple[int, int, list[int]]]]]]:
        """Score and pieces of the best segmentation, and for the following ones their score and edits.

        An edit is (start, length, pieces): that many pieces of the best segmentation give way to these.
        """
        scores, ids, _, more = self.encode_all([text], nbest)
        return float(scores[0]), ids, more[0]

    def encode_all(self, texts: list[str | None], nbest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list]]:
        """encode() of many texts, a null one being empty: scores, all pieces, where texts begin in them, alternatives."""
        split = [self.words(t) if t else ([], None) for t in texts]
        flat = [w for words, _ in split for w in words]
        signs = [sign for words, sign in split for _ in words] if any(sign for _, sign in split) else None
        # A word with a sign, which differs from text to text, is solved for its text alone.
        alone = {} if signs is None else {k: self.best_of(w, sign) for k, (w, sign) in enumerate(zip(flat, signs, strict=True)) if sign is not None and sign in w}
        self._learn({w for k, w in enumerate(flat) if k not in alone} if alone else set(flat))
        known = self.known
        score, loss, begin, long, pool = self._score, self._loss, self._begin, self._long, self._pool
        if alone:
            own = self._columns(list(alone.values()))
            at = np.array([-1 if k in alone else known[w] for k, w in enumerate(flat)], np.int64)
            at[at < 0] = len(score) + np.arange(len(alone))
            begin = np.concatenate([begin, len(pool) + np.cumsum(own[3]) - own[3]])
            score, loss, pool, long = (np.concatenate(x) for x in ((score, own[0]), (loss, own[1]), (pool, own[2]), (long, own[3])))
        else:
            at = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
        # The pieces of all words in order.
        each = long[at]
        upto = np.concatenate([[0], np.cumsum(each)])
        ids = pool[np.arange(upto[-1]) - np.repeat(upto[:-1] - begin[at], each)]
        count = np.array([len(words) for words, _ in split], np.int64)
        cut = np.concatenate([[0], np.cumsum(count)])
        total = np.bincount(np.repeat(np.arange(len(texts)), count), weights=score[at], minlength=len(texts)).astype(np.float64)
        more = [[] for _ in texts]
        for i, (words, sign) in enumerate(split if nbest > 1 else ()):
            lo, hi = cut[i], cut[i + 1]
            losses = loss[at[lo:hi]]
            near = np.argsort(losses, kind="stable")[: nbest - 1]
            near = near[np.isfinite(losses[near])].tolist()
            if near:
                options = [self._losses(words[k], sign, nbest, score[at[lo + k]], ids[upto[lo + k] : upto[lo + k + 1]]) for k in near]
                first = [(int(upto[lo + k] - upto[lo]), int(each[lo + k])) for k in near]
                for lost, choice in self._combined(options, nbest)[1:]:
                    edits = [(*first[k], list(options[k][c][1])) for k, c in enumerate(choice) if c]
                    more[i].append((float(total[i] - lost), sorted(edits)))
        return total, ids, upto[cut], more

    def _losses(self, word: str, sign: str | None, nbest: int, score: float, ids: np.ndarray) -> list[tuple[float, tuple[int, ...]]]:
        """Losses and pieces of the nbest paths of a word; the first is the best path that best_of() gave."""
        key = (word, nbest)
        signed = sign is not None and sign in word
        got = None if signed else self.other.get(key)
        if got is None:
            best = tuple(ids.tolist())
            rest = []
            for s, other in self.paths(word, sign if signed else None, nbest):
                if other != best:
                    rest.append((float(score - s), other))
                if len(rest) + 1 >= nbest:
                    break
            got = [(0.0, best), *rest]
            if not signed and len(word) <= _SOLVED:
                if len(self.other) >= ALTERNATIVES_KEPT:
                    self.other.clear()
                self.other[key] = got
        return got

    @staticmethod
    def _combined(options: list[list[tuple[float, tuple]]], nbest: int) -> list[tuple[float, tuple[int, ...]]]:
        """The nbest choices of one option for each word, by their sum of losses."""
        start = (0,) * len(options)
        agenda, seen, out = [(0.0, start)], {start}, []
        while agenda and len(out) < nbest:
            loss, choice = heapq.heappop(agenda)
            out.append((loss, choice))
            for k, o in enumerate(options):
                if choice[k] + 1 < len(o):
                    following = (*choice[:k], choice[k] + 1, *choice[k + 1 :])
                    if following not in seen:
                        seen.add(following)
                        heapq.heappush(agenda, (sum(options[j][c][0] for j, c in enumerate(following)), following))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation."""
        text = self.spell(ids).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The bytes of the texts of many segmentations, text i having the pieces bounds[i]:bounds[i + 1]."""
        taken = self.spelled_column.take(pa.array(ids))
        ends = np.frombuffer(taken.buffers()[1], np.int32, len(ids) + 1)[bounds]
        # Without the space in front, which every text but an empty one has.
        some = ends[1:] > ends[:-1]
        data = np.delete(np.frombuffer(taken.buffers()[2] or b"", np.uint8), ends[:-1][some])
        ends = ends - np.concatenate([[0], np.cumsum(some)]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])

    def spell(self, ids: list[int]) -> bytes:
        """The bytes that pieces stand for, the space in front of the text among them."""
        return b"".join(map(self.spelled.__getitem__, ids))

    def same(self, ids: list[int], edits: list[tuple[int, int, list[int]]]) -> bool:
        """Whether the segmentation with these edits decodes to the same bytes, and so to the same text."""
        return all(self.spell(list(ids[start : start + length])) == self.spell(new) for start, length, new in edits)


_split = re.compile(rf"{MARK}+[^{MARK}]*").findall


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary to a worker."""
    return Vocabulary(path)


ALTERNATIVES = T.ArrayType(
    T.StructType([T.StructField("score", T.DoubleType()), T.StructField("edits", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("pieces", T.ArrayType(T.IntegerType()))])))])
)


def _nested(more: list[list[tuple[float, list[tuple[int, int, list[int]]]]]], gone: np.ndarray) -> pa.Array:
    """The alternatives of many texts as one column."""
    alternatives = [a for m in more for a in m]
    edits = [e for _, es in alternatives for e in es]
    offsets = lambda parts: np.cumsum([0, *map(len, parts)], dtype=np.int32)
    pieces = pa.ListArray.from_arrays(pa.array(offsets([e[2] for e in edits])), pa.array([i for e in edits for i in e[2]], pa.int32()))
    each = pa.StructArray.from_arrays([pa.array([e[0] for e in edits], pa.int32()), pa.array([e[1] for e in edits], pa.int32()), pieces], ["start", "length", "pieces"])
    lists = pa.ListArray.from_arrays(pa.array(offsets([es for _, es in alternatives])), each)
    whole = pa.StructArray.from_arrays([pa.array([s for s, _ in alternatives], pa.float64()), lists], ["score", "edits"])
    return pa.ListArray.from_arrays(pa.array(offsets(more), mask=np.append(gone, False)), whole)


def encode(frame: DataFrame, text: str = "text", nbest: int = NBEST, model: str = MODEL, reread: bool = False) -> DataFrame:
    """Adds pieces, piece_score and alternatives, the 2nd to nbest-th segmentations as edits of the first.

    With reread, also decoded, the text that the pieces give back, and read_back, how many segmentations, the first
    and the alternatives, give back the text exactly. Columns of these names give way. The model file is read where the work is done, by the path given.
    """
    own = ["pieces", "piece_score", "alternatives", *(["decoded", "read_back"] if reread else [])]
    frame = frame.drop(*own)
    names = frame.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in (p for whole in batches for p in slices(whole, text, 1 << 20)):
            body = batch[text]
            texts = body.to_pylist()
            gone = np.array([t is None for t in texts])
            scores, ids, bounds, more = v.encode_all(texts, nbest)
            flat = pa.array(ids)
            columns = [
                pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32), mask=np.append(gone, False)), flat),
                pa.array(scores, mask=gone),
                _nested(more, gone),
            ]
            if reread:
                decoded = v.decode_all(ids, bounds)
                same = np.asarray(pc.fill_null(pc.equal(decoded, body.cast(pa.binary())), False))
                read = [ok * (1 + sum(v.same(ids[b:], edits) for _, edits in m)) for ok, b, m in zip(same.tolist(), bounds.tolist(), more, strict=False)]
                columns += [pc.if_else(pa.array(gone), pa.scalar(None, pa.string()), decoded.cast(pa.string())), pa.array(read, pa.int64(), mask=gone)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*names, *own])

    added = [T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("piece_score", T.DoubleType()), T.StructField("alternatives", ALTERNATIVES)]
    added += [T.StructField("decoded", T.StringType()), T.StructField("read_back", T.LongType())] if reread else []
    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, *added]))


def decode(frame: DataFrame, column: str = "pieces", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """Adds the text of a column of pieces; null pieces give a null text."""
    frame = frame.drop(out)
    names = frame.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            texts = [None if ids is None else v.decode(ids) for ids in batch[column].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, out])

    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, T.StructField(out, T.StringType())]))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmentations of every document, and what they decode to."""
    found = encode(table(spark, sf_dir, "documents", "doc_id", "text"), reread=True)
    return found.select("doc_id", F.coalesce(F.size("pieces"), F.lit(0)).cast("long").alias("n_pieces"), "piece_score", "pieces", "alternatives", "decoded", "read_back")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: documents with the pieces of their texts and the alternatives."""
    return encode(docs.select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", "pieces", "piece_score", "alternatives")

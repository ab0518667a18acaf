"""Language identification by cross-parsing entropy with suffix automata.

A suffix automaton of labelled text of each language accepts just the substrings of that text. A text is parsed against
it: each phrase is the longest match from where the last one ended. A language whose text resembles the document's needs
few phrases; phrases per letter, the cross-parsing entropy up to a factor, is least for the predicted language.

Automata of all languages share one table of arcs, as large as the arcs are many. Many blocks of text are then parsed at
once, a letter a step, as array look-ups; a letter that ends a phrase leads on from the start state. Blocks have at most
``BLOCK`` letters; a phrase doesn't go on into the next block of its text, in any language.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import blocks, small_batches, staged

BLOCK = 512
UNKNOWN = "und"
#: Bounds of what is taught: whole documents per language, their characters together, and languages. The model's arrays,
#: which are broadcast, take some 40 bytes a character.
DOCS_PER_LANGUAGE, LETTERS_PER_LANGUAGE, LANGUAGES = 60, 40_000, 500
#: Moves (states x letters) up to which a task lays them out in full, 4 bytes each; it parses twice as fast with them.
DENSE = 20_000_000
log = logging.getLogger("veriplumb")


def letters_of(text: str) -> str:
    """Lower case, with every run of other characters than letters as one blank."""
    return "".join(c if c.isalpha() else " " for c in text.lower())


@lru_cache(1)
def _alphabetic() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return moves


class Moves:
    """Transitions of automata by row displacement: an arc of state s and letter c lies at ``base[s] + c``, if ``owner``
    there is s. The arrays grow with the arcs, whatever the alphabet, and a look-up takes no search."""

    def __init__(self, states: list[dict[int, int]], width: int):
        arcs = np.fromiter((len(own) for own in states), np.int64, len(states))
        owner, many = np.repeat(np.arange(len(states)), arcs), int(arcs.sum())
        letter = np.fromiter((c for own in states for c in own), np.int64, many)
        target = np.fromiter((to for own in states for to in own.values()), np.int64, many)
        base = np.zeros(len(states), np.int64)
        used, low = bytearray(4 * len(states) + 2 * width), 0
        for s in np.argsort(-arcs, kind="stable")[: int((arcs > 1).sum())].tolist():
            letters = sorted(states[s])
            at, tried = max(0, low - letters[0]), 0
            while any(used[at + c] for c in letters):
                at, tried = at + 1, tried + 1
                if at + width >= len(used):
                    used.extend(bytes(len(used)))
            if tried > 16:  # dense enough here: single arcs fill the gaps
                low += tried // 2
            base[s] = at
            for c in letters:
                used[at + c] = 1
        single = np.flatnonzero(arcs == 1)
        used.extend(bytes(len(single) + width))
        free = width + np.flatnonzero(np.frombuffer(used, np.uint8)[width:] == 0)[: len(single)]
        base[single] = free - letter[(np.cumsum(arcs) - arcs)[single]]
        self.base, at = base, base[owner] + letter
        self.arcs = np.full(max(int(at.max(initial=0)), int(base.max(initial=0))) + width + 1, -1, np.int64)  # owner, then target
        self.arcs[at] = owner << 32 | target

    def go(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each state goes by its letter, and whether it does."""
        at = self.base.take(state)
        at += letter
        arc = self.arcs.take(at)
        on = arc >> 32 == state
        arc &= 0xFFFFFFFF
        return arc, on

    def dense(self, width: int, starts: list[int], ends: list[int]) -> np.ndarray:
        """All moves as one array, states x letters; a letter that begins a phrase is marked by the sign."""
        at = np.flatnonzero(self.arcs >= 0)
        owner, target = self.arcs[at] >> 32, (self.arcs[at] & 0xFFFFFFFF).astype(np.int32)
        letter = at - self.base[owner]
        table = np.empty((len(self.base), width), np.int32)
        for start, end in zip(starts, ends, strict=True):
            row = np.full(width, end, np.int32)
            own = owner == start
            row[letter[own]] = target[own]
            table[start : end + 1] = -row - 1
        table[owner, letter] = target
        return table.ravel()


class Model:
    """Automata of all languages. ``alphabet``: code point -> letter; letter 0 is any other, 1 the blank."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        texts = [" ".join(letters_of(samples[k]).split()) for k in self.languages]
        self.alphabet = np.zeros(0x110000, np.int32)
        self.letters = _alphabetic()
        chars = sorted(set("".join(texts)) - {" "})
        for i, c in enumerate(chars):
            self.alphabet[ord(c)] = i + 2
        self.alphabet[32] = 1
        states: list[dict[int, int]] = []
        self.starts, self.ends = [], []  # of a language: its start state, and a state that no letter leads on from
        for t in texts:
            moves, first = suffix_automaton(self.alphabet[np.frombuffer(t.encode("utf-32-le"), np.uint32)].tolist()), len(states)
            states += [{c: to + first for c, to in own.items()} for own in moves]
            states.append({})
            self.starts.append(first)
            self.ends.append(len(states) - 1)
        self.width = len(chars) + 2
        self.moves, self.table = Moves(states, self.width), None

    def __getstate__(self):
        return self.__dict__ | {"table": None}  # only the arcs are sent

    def _tabled(self) -> np.ndarray | None:
        if self.table is None and len(self.moves.base) * self.width <= DENSE:
            self.table = self.moves.dense(self.width, self.starts, self.ends)
        return self.table

    def phrases(self, codes: np.ndarray, used: np.ndarray) -> np.ndarray:
        """Phrases of each block and language. ``codes``: letters x blocks, blocks by falling length; ``used``: lengths."""
        n = codes.shape[1]
        starts, ends = np.array(self.starts, np.intp), np.array(self.ends, np.intp)
        state = np.repeat(ends[:, None], n, axis=1)
        count = np.zeros((len(starts), n), np.int32)
        alive = np.searchsorted(-used, -np.arange(codes.shape[0]), "left")
        k, table = n, self._tabled()
        for t in range(codes.shape[0]):
            if int(alive[t]) < k:
                k = int(alive[t])
                if not k:
                    break
                state = np.ascontiguousarray(state[:, :k])
            if table is not None:
                state *= self.width
                state += codes[t, :k]
                to = table.take(state)
                fresh = to < 0
                count[:, :k] += fresh
                state = np.where(fresh, -1 - to, to).astype(np.intp)
                continue
            to, on = self.moves.go(state, codes[t, :k])
            miss = np.flatnonzero(~on)  # a phrase ends before this letter, which begins the next
            language, block = np.divmod(miss, k)
            fresh, known = self.moves.go(starts[language], codes[t].take(block))
            to.put(miss, np.where(known, fresh, ends[language]))
            count[language, block] += 1
            state = to
        return count

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; the score is by how much the best needs fewer phrases than the second."""
        lower = [(t or "").lower() for t in texts]
        sizes = np.array([len(t) for t in lower], np.int64)
        points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = self.letters[points]
        doc = np.repeat(np.arange(len(lower)), sizes)
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]  # one blank after each run of letters
        codes = np.where(is_letter, self.alphabet[points], 1)[keep].astype(np.intp)
        n_letters = np.bincount(doc[is_letter], minlength=len(lower))
        length = np.bincount(doc[keep], minlength=len(lower))
        if not self.languages or not len(codes):
            return [UNKNOWN] * len(lower), [0.0] * len(lower)
        start = np.cumsum(length) - length
        blocks_of = -(-length // BLOCK)
        owner = np.repeat(np.arange(len(lower)), blocks_of)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks_of) - blocks_of, blocks_of)
        at = start[owner] + nth * BLOCK
        used = np.minimum(BLOCK, length[owner] - nth * BLOCK)
        order = np.argsort(-used, kind="stable")
        at, used, owner = at[order], used[order], owner[order]
        total = np.zeros((len(self.languages), len(lower)), np.int64)
        padded = np.append(codes, np.zeros(BLOCK, np.intp))
        for a in range(0, len(at), 4096):
            own = slice(a, a + 4096)
            matrix = padded[at[None, own] + np.arange(int(used[a]))[:, None]]
            found = self.phrases(matrix, used[own])
            for i, row in enumerate(found):
                total[i] += np.bincount(owner[own], weights=row, minlength=len(lower)).astype(np.int64)
        rate = total / np.maximum(length, 1)
        best = rate.argmin(axis=0)
        least = rate.min(axis=0)
        if len(self.languages) > 1:
            score = 1 - least / np.partition(rate, 1, axis=0)[1].clip(1e-12)
        else:
            score = np.ones(len(lower))
        score = np.where(n_letters > 0, score.clip(0, 1), 0.0)
        return [self.languages[b] if n else UNKNOWN for b, n in zip(best.tolist(), n_letters.tolist(), strict=True)], score.tolist()


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", seed: int = 11, docs_per_language: int = DOCS_PER_LANGUAGE, letters: int = LETTERS_PER_LANGUAGE, languages: int = LANGUAGES) -> Model:
    """A model from a bounded sample of the rows of ``docs`` with text and language.

    Of each language it takes ``docs_per_language`` different texts of at most ``letters`` characters, those of least
    seeded hash, and of these, in that order, the whole texts that fit in ``letters`` together. A language that has only
    longer texts is taught by its shortest one, whole. Of more than ``languages`` values of the column those with the
    most rows are taught, and a warning is logged; ties go by name. Without labelled rows the model knows no language.
    """
    rows = docs.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).filter("lang is not null and text rlike '\\\\p{L}'")
    rows = rows.withColumn("draw", F.xxhash64(F.lit(seed), "text")).withColumn("size", F.char_length("text"))
    sizes = staged(rows.select("lang", "draw", "size").distinct())
    taught = sizes.groupBy("lang").agg(F.count("*").alias("n"), F.min("size").alias("least")).orderBy(F.desc("n"), "lang").limit(languages + 1).collect()
    if len(taught) > languages:
        log.warning("more than %d languages; those with the fewest texts are not taught", languages)
    taught = taught[:languages]
    if not taught:
        return Model({})
    limit = {r["lang"]: max(letters, r["least"]) for r in taught}
    limits = docs.sparkSession.createDataFrame(list(limit.items()), "lang string, most long")  # at most ``languages`` rows
    drawn = sizes.join(F.broadcast(limits), "lang").filter(F.col("size") <= F.col("most")).withColumn("part", F.pmod("draw", F.lit(64)))
    for group in (["lang", "part"], ["lang"]):  # a language of most rows is cut down in parts first
        rank = F.row_number().over(Window.partitionBy(*group).orderBy("draw"))
        drawn = drawn.withColumn("rank", rank).filter(F.col("rank") <= docs_per_language)
    room, chosen = dict(limit), set()
    for r in sorted(drawn.select("lang", "draw", "size").collect()):  # at most docs_per_language rows a language
        if r["size"] <= room[r["lang"]]:
            room[r["lang"]] -= r["size"]
            chosen.add((r["lang"], r["draw"]))
    wanted = docs.sparkSession.createDataFrame(sorted(chosen), "lang string, draw long")
    texts = rows.join(F.broadcast(wanted), ["lang", "draw"]).groupBy("lang", "draw").agg(F.min("text").alias("text"))
    samples: dict[str, list] = {}
    for r in texts.collect():
        samples.setdefault(r["lang"], []).append((r["draw"], r["text"]))
    return Model({k: " ".join(p for _, p in sorted(x)) for k, x in samples.items()})


def predictor(model_of):
    """A function for ``mapInArrow`` over ``doc_id, text, *``: the other columns, language and score."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of.value
        for b in blocks(batches, "text", 1 << 20):
            said, score = model.predict(b.column("text").to_pylist())
            keep = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(said, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score`` for each row of ``docs``.

    Null text, and text without letters, has language ``und`` and score 0; ties go to the language first by name;
    repeated rows and null ids stay; no rows give no rows; columns besides the two named are ignored.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(predictor(shared), "doc_id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id's text modulo 3 is 1."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def with_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; equal names among its columns are replaced.

    The function is marked as not deterministic, though it is, so that each text is parsed once: a later filter by the
    prediction would otherwise be moved below it with a call of its own, in a second worker of each task.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def said(text: pa.Array) -> pa.Array:
        parts = [shared.value.predict(b.column("text").to_pylist()) for b in blocks([pa.RecordBatch.from_arrays([text], names=["text"])], "text", 1 << 20)]
        return pa.StructArray.from_arrays([pa.array([x for a, _ in parts for x in a], pa.string()), pa.array([x for _, b in parts for x in b], pa.float64())], ["lang_pred", "score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), said.asNondeterministic()(F.col(f"`{text_col}`").cast("string")).alias("__said"))
    return rows.select(*(F.col(f"`{c}`") for c in kept), "__said.lang_pred", "__said.score")

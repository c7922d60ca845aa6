"""Language by cross-parsing: how few phrases of a language's labelled text does it take?

A text is read from left to right as phrases, each the longest stretch that occurs in the labelled
text of a language (Ziv and Merhav 1993). A suffix automaton of that text recognises exactly its
substrings, so a phrase ends where the automaton has no way on. Phrases are fewer the more alike the
texts are; their number is normalised by the size of the language's sample, and the least wins.

Texts are read in blocks, each of which begins a new phrase, so that many blocks of all languages
advance together: one step looks up the next state of thousands of readers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from parley.llm.common import beside, remainder, unit

#: Bounds on what is learned from, for each language: texts, and characters of them altogether.
TEXTS = 64
CHARS = 24_000
SEED = 9
BLOCK = 1024
BY, HELD = 3, 1


def normalised(text: str) -> str:
    """Lower case; everything but letters becomes single blanks."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


class Automaton:
    """Suffix automaton of a text over numbered letters: ``ways`` has the next states of each state."""

    def __init__(self, codes: list[int]):
        links, lengths, ways = [-1], [0], [{}]
        last = 0
        for code in codes:
            new = len(ways)
            links.append(0)
            lengths.append(lengths[last] + 1)
            ways.append({})
            at = last
            while at != -1 and code not in ways[at]:
                ways[at][code] = new
                at = links[at]
            if at != -1:
                to = ways[at][code]
                if lengths[at] + 1 == lengths[to]:
                    links[new] = to
                else:
                    twin = len(ways)
                    links.append(links[to])
                    lengths.append(lengths[at] + 1)
                    ways.append(dict(ways[to]))
                    while at != -1 and ways[at].get(code) == to:
                        ways[at][code] = twin
                        at = links[at]
                    links[to] = links[new] = twin
            last = new
        self.ways = ways


class _Slots:
    """The ways of many states in one array: state ``s`` on letter ``c`` is slot ``offset[s] + c``, if that is its own.

    States lie over each other like combs, so there are about as many slots as ways, at most three for each
    learned letter, however large the alphabet is.
    """

    def __init__(self):
        self.owner = np.full(1 << 12, -1, dtype=np.int32)
        self.target = np.zeros(1 << 12, dtype=np.int32)
        self.offset: list[int] = []
        self.low = 0

    def _room(self, size: int) -> None:
        while len(self.owner) < size:
            self.owner = np.concatenate([self.owner, np.full(len(self.owner), -1, dtype=np.int32)])
            self.target = np.concatenate([self.target, np.zeros(len(self.target), dtype=np.int32)])

    def add(self, ways: list[dict[int, int]], size: int, step: int = 1024) -> None:
        """Place the states of one automaton over letters below ``size``."""
        base = len(self.offset)
        self.offset += [0] * len(ways)
        # what earlier automata have filled is not looked through again
        self.low = size + next(iter(np.flatnonzero(self.owner[size:] < 0).tolist()), max(len(self.owner) - size, 0))
        several = sorted((s for s in range(len(ways)) if len(ways[s]) > 1), key=lambda s: -len(ways[s]))
        for state in several:
            letters = sorted(ways[state])
            while self.low < len(self.owner) and self.owner[self.low] >= 0:
                self.low += 1
            shift = max(self.low, letters[0]) - letters[0]
            while True:
                self._room(shift + letters[-1] + step)
                fits = self.owner[shift + letters[0] : shift + letters[0] + step] < 0
                for c in letters[1:]:
                    fits &= self.owner[shift + c : shift + c + step] < 0
                first = int(fits.argmax())
                if fits[first]:
                    shift += first
                    break
                shift += step
            self.offset[base + state] = shift
            at = shift + np.array(letters)
            self.owner[at] = base + state
            self.target[at] = base + np.array([ways[state][c] for c in letters])
        # nearly all states have one way: they fill what is free, all at once
        single = [(s, *way) for s in range(len(ways)) if len(ways[s]) == 1 for way in ways[s].items()]
        if not single:
            return
        states, letters, targets = (np.array(x) for x in zip(*single))
        free = size + np.flatnonzero(self.owner[size:] < 0)
        if len(free) < len(single):
            self._room(len(self.owner) + len(single))
            free = size + np.flatnonzero(self.owner[size:] < 0)
        at = free[: len(single)]
        for state, shift in zip(states.tolist(), (at - letters).tolist()):
            self.offset[base + state] = shift
        self.owner[at] = base + states
        self.target[at] = base + targets


def learned(samples: dict[str, str]) -> dict:
    """Automata of several languages as plain arrays, which is how they travel to the tasks.

    Languages have letters in common, but their states only take room for the ways they have.
    """
    languages = sorted(samples)
    letters = sorted(set("".join(samples.values())) | {" "})
    codes = np.zeros(0x110000, dtype=np.uint16 if len(letters) < 65535 else np.uint32)
    codes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)  # 0: in no sample
    codes[[i for i in range(0x110000) if not chr(i).isalpha()]] = codes[32]
    slots, roots = _Slots(), []
    starts = np.zeros((len(languages), len(letters) + 1), dtype=np.int32)
    for number, language in enumerate(languages):
        ways = Automaton(codes[[ord(c) for c in samples[language]]].tolist()).ways
        base = len(slots.offset)
        slots.add(ways, len(letters) + 1)
        roots.append(base)
        starts[number] = base
        for code, to in ways[0].items():
            starts[number, code] = base + to
    # the last slot that can be asked for, whose owner may be nobody
    most = max(slots.offset, default=0) + len(letters) + 1
    slots._room(most)
    return {
        "languages": languages,
        "codes": codes,
        "offset": np.array(slots.offset, dtype=np.int32),
        "owner": slots.owner[:most],
        "target": slots.target[:most],
        "roots": roots,
        "starts": starts,
        # a phrase names a place in a sample, which takes more bits the larger the sample is
        "weights": np.array([np.log2(len(samples[x]) + 2) for x in languages]),
    }


def read(model: dict, text: str) -> np.ndarray:
    """Letter codes of the lower-cased text, with single blanks for everything else."""
    codes = model["codes"][np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    blank = codes == model["codes"][32]
    return codes[~(blank & np.concatenate([[True], blank[:-1]]))] if len(codes) else codes


def phrases(model: dict, texts: list[str]) -> np.ndarray:
    """Number of phrases of every text (rows) in every language (columns), texts read whole.

    A letter that a language has nowhere begins a phrase, which goes on with what follows the letter; at
    the start of a block it ends an empty one.
    """
    counts = np.zeros((len(texts), len(model["languages"])), dtype=np.int64)
    blocks, owners = [], []
    for i, text in enumerate(texts):
        codes = read(model, text)
        for at in range(0, len(codes), BLOCK):
            blocks.append(codes[at : at + BLOCK])
            owners.append(i)
    if not blocks or not model["languages"]:
        return counts
    order = np.argsort([-len(b) for b in blocks], kind="stable")
    lengths = np.array([len(blocks[k]) for k in order])
    whose = np.array(owners)[order]
    grid = np.zeros((lengths[0], len(blocks)), dtype=np.int32)
    for column, k in enumerate(order):
        grid[: lengths[column], column] = blocks[k]
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    offset, owner, target = model["offset"], model["owner"], model["target"]
    for number, root in enumerate(model["roots"]):
        start = model["starts"][number]
        state = np.full(len(blocks), root, dtype=np.int32)
        ended = np.ones(len(blocks), dtype=np.int64)
        for step in range(lengths[0]):
            n = active[step]
            letter, here = grid[step, :n], state[:n]
            slot = offset[here] + letter
            on = owner[slot] == here
            # no way on: the phrase ends and the character begins the next one
            ended[:n] += ~on
            state[:n] = np.where(on, target[slot], start[letter])
        np.add.at(counts[:, number], whose, ended)
    return counts


def predict(model: dict, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of every text; ``und`` and 0 without a letter or without a language.

    The score sets the runner-up's phrases in relation to both: a half is a tie, which the least
    name wins, and 1 would be a text that only one language can read.
    """
    present = ["" if t is None else t for t in texts]
    costs = phrases(model, present) * model["weights"]
    names, scores = [], np.zeros(len(texts))
    for i, text in enumerate(present):
        if not model["languages"] or not any(c.isalpha() for c in text):
            names.append("und")
            continue
        best = int(np.argmin(costs[i]))
        rest = np.delete(costs[i], best)
        names.append(model["languages"][best])
        scores[i] = rest.min() / (rest.min() + costs[i][best]) if len(rest) else 1.0
    return names, scores


def samples(
    docs: DataFrame,
    learn: Column,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    texts: int = TEXTS,
    chars: int = CHARS,
    seed: int = SEED,
) -> dict[str, str]:
    """Up to ``chars`` characters of labelled text for each language, of about ``texts`` texts drawn.

    Texts are chosen by a hash of the key, as a share that follows from a count of the labels; from
    each comes a stretch of up to four times ``chars / texts``, so what the driver gets is bounded. They
    are joined until ``chars`` is full: long texts fill it with a quarter of those drawn.
    """
    known = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    # one number for each language; the scan then drops nearly all rows before anything moves
    totals = {row[0]: row[1] for row in known.groupBy(lang).count().collect()}
    if not totals:
        return {}
    shares = F.create_map(*[F.lit(x) for name, n in sorted(totals.items()) for x in (name, texts / n)])
    pick = unit(F.col(key), seed=seed)
    part = max(1, chars // texts * 4)
    room = F.greatest(F.length(text) - part, F.lit(0))
    start = 1 + F.floor(unit(F.col(key), seed=seed + 1) * room).cast("int")
    chosen = (
        known.filter(pick < F.element_at(shares, F.col(lang)))
        .select(F.col(lang).alias("l"), F.substring(F.col(text), start, F.lit(part)).alias("t"), pick.alias("u"))
    )
    gathered: dict[str, list[tuple[float, str]]] = {}
    for row in chosen.select("l", "u", "t").collect():
        gathered.setdefault(row["l"], []).append((row["u"], row["t"]))
    return {name: normalised(" ".join(t for _, t in sorted(found)))[:chars] for name, found in gathered.items()}


def language(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score) for every row of ``docs``.

    Learned from bounded stretches of texts with a language whose key is not held out. NULL texts
    and texts without a letter are ``und`` with score 0, as all are if nothing can be learned. A
    NULL key is not held out and never learned from; equal keys stay apart; a tie goes to the least
    name. Other columns than key, text and language are not looked at.
    """
    learn = remainder(F.col(key), BY) != HELD
    model = docs.sparkSession.sparkContext.broadcast(learned(samples(docs, learn, key, text, lang)))

    def run(texts: list[str | None]) -> list[pa.Array]:
        names, scores = predict(model.value, texts)
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    held_out = F.coalesce(remainder(F.col(key), BY) == HELD, F.lit(False))
    rows = docs.select(F.col(key).alias("key"), held_out.alias("held_out"), F.col(text).alias("t"))
    told = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return beside(rows, "t", told, run, 2_000_000).withColumnRenamed("key", key)

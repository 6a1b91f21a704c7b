"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer rewrites a clause's words, and the multi-word phrases among them, to symbols (insult, threat, target, copula,
intent, negation, reporting verb, quote mark, other). Weighted transducers read the symbols and give each insult or threat a
factor: ``negation`` those shortly after a negation, ``reported`` those after a reporting verb or inside quotes, ``target`` those near someone
addressed, ``threat`` those announced by a verb of intent, ``insult`` those said of someone (target, copula, insult) or heaped up. They are
composed once into a single machine whose factors multiply; a second one reads from right to left for targets that follow.
A clause scores the sum of its weighted matches, and a logistic curve over a text's clause scores gives its score.

The insult lexicon is a weighted prefix automaton learned from labelled texts: a prefix's weight is its log-odds, a
longer prefix or whole word with enough support overrides a shorter one (so exceptions are learned too). The patterns' words are learned as well,
beside short fixed lists: phrases are pairs of neighbouring words that toxic texts hold far more often than others although neither word is in the
lexicon; threats are learned insults that a verb of intent mostly announces; and words round a match that move the odds of the label become
negations (near before it), reporting words (anywhere before it) or targets. What is counted for phrases and for words round a match is different
surroundings, not texts, so copies of one passage count once; all must move the odds by ``SURE`` standard errors (by likelihood ratio). The machines' factors, the weights of
fixed threats and phrases, and the curve are fitted together: the machines are run once over polynomials in place of numbers, so
that a match keeps which factors it takes, and the likelihood of the labels is raised factor by factor, with a
penalty on leaving the defaults (which stand where the labels say nothing). All of it is fitted on about ``SAMPLE`` labelled
texts taken by hash; that bound is a parameter, and it bounds the lexicon. Every text is scored whole.

Defined results: a null, empty or wordless text has no match and the curve's lowest score; repeated rows score
alike; rows without a label teach nothing, and several labels of one id are taken as one, toxic if any is; without any
usable label a small fixed lexicon and curve stand in; other columns are not read.
"""

from __future__ import annotations

import functools
import json
import math
import operator
import re
import zlib
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, documents, is_held_out, materialize

SAMPLE = 30_000
SHORTEST, LONGEST = 3, 16
SUPPORT = 8
SURE = 5.0
THRESHOLD = 0.3
#: Bits of the filter that keeps pairs of words which no toxic text holds often from being counted elsewhere.
PAIR_BITS = 1 << 20

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, INTENT, COPULA = SYMBOLS = range(9)

TARGETS = "you your yours yourself u he him his she her they them their du dich dir dein deine ihr euch euer sie ihn tu te toi ton ta vous votre il elle ils tú ti usted ustedes vosotros él ella ellos".split()
NEGATIONS = "not no never none nobody isn't aren't wasn't don't didn't nicht kein keine keinen nie niemals ne pas jamais aucun nunca jamás ningún tampoco".split()
REPORTS = "said says say saying called calls told tells wrote writes claimed claims quoted reported sagte sagt nannte schrieb behauptete dit disait écrit appelé raconte dijo dice llamó escribió".split()
INTENTS = "will gonna going shall must should hope wish deserve deserves i'll we'll werde werden wird wirst soll sollst vais va allons allez voy vas vamos debes".split()
COPULAS = "are is am be were was such bist ist seid sind es est êtes sont eres sois son".split()
CONTRACTIONS = "you're he's she's they're".split()
THREATS = "kill murder hurt beat destroy stab shoot strangle töten umbringen schlagen erschießen tuer frapper égorger matar golpear apuñalar".split()
INSULT_PHRASES = ["piece of trash", "piece of garbage", "waste of space", "waste of oxygen", "shut up", "good for nothing", "halt die klappe", "ferme ta gueule", "cierra la boca"]
THREAT_PHRASES = ["watch your back", "you will regret", "make you pay", "go to hell", "burn in hell", "drop dead", "fahr zur hölle", "va en enfer", "vete al infierno"]
SEED_INSULTS = "idiot moron stupid scum loser worthless disgusting pathetic trash clown dumm idiotin arschloch crétin imbécile salaud estúpido imbécil".split()

#: The machines' factors and the weights of matches that no label taught: defaults, which the labels move.
FACTORS = {"negated": 0.25, "reported": 0.5, "near": 1.25, "aimed": 1.25, "intended": 1.5, "predicated": 1.25, "heaped": 1.1, "threat": 2.0, "phrase": 2.0}
NAMES = tuple(FACTORS)
_STEPS = (0.2, 0.5, 0.8, 1.25, 2.0, 5.0)

_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*|[\"“”«»„]")
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)*|[\"“”«»„.!?;\n]")
_CLAUSE_END = re.compile(r"[.!?;\n]")
_LETTER = re.compile(r"[^\W_]")


class Transducer:
    """``step(state, symbol) -> (state, factor)``, deterministic; the factor counts at insults and threats."""

    def __init__(self, table: dict[tuple[int, int], tuple], states: int):
        self.table, self.states = table, states

    def compose(self, other: Transducer, times=operator.mul) -> Transducer:
        """Both at once over the same symbols: product states, factors multiplied."""
        table = {}
        for (a, x), (a2, f) in self.table.items():
            for b in range(other.states):
                b2, g = other.table[b, x]
                table[a * other.states + b, x] = (a2 * other.states + b2, times(f, g))
        return Transducer(table, self.states * other.states)


def _reach_machine(opens: int, reach: int, factor, one, at: tuple[int, ...] = SYMBOLS) -> Transducer:
    """State: words left within the reach of a symbol; the factor holds for the symbols ``at`` within it."""
    table = {}
    for s in range(reach + 1):
        for x in SYMBOLS:
            table[s, x] = (reach if x == opens else max(0, s - 1), factor if s and x in at else one)
    return Transducer(table, reach + 1)


def negation_machine(reach: int = 3, factor=0.25, one=1.0) -> Transducer:
    return _reach_machine(NEGATION, reach, factor, one)


def target_machine(reach: int = 4, factor=1.25, one=1.0) -> Transducer:
    return _reach_machine(TARGET, reach, factor, one)


def threat_machine(reach: int = 4, factor=1.5, one=1.0) -> Transducer:
    """Threats that a verb of intent announces."""
    return _reach_machine(INTENT, reach, factor, one, (THREAT,))


def reported_machine(factor=0.5, one=1.0) -> Transducer:
    """States: own speech, after a reporting verb, in quotes, in quotes after a reporting verb."""
    table = {}
    for s in range(4):
        for x in SYMBOLS:
            to = s | 1 if x == REPORT else s ^ 2 if x == QUOTE else s
            table[s, x] = (to, factor if s else one)
    return Transducer(table, 4)


def insult_machine(reach: int = 3, predicated=1.25, heaped=1.1, one=1.0, times=operator.mul) -> Transducer:
    """Insults said of someone (a target, a copula within two words, the insult within ``reach``), and insults that follow one another."""
    table = {}
    for s in range(3 + reach):  # 0: none; 1, 2: words left after a target; above: after its copula
        for x in SYMBOLS:
            to = 2 if x == TARGET else 2 + reach if x == COPULA and s else s - 1 if s not in (0, 3) else 0
            table[s, x] = (to, predicated if x == INSULT and s > 2 else one)
    return Transducer(table, 3 + reach).compose(_reach_machine(INSULT, 2, heaped, one, (INSULT,)), times)


def grammar(f: dict, one=1.0, times=operator.mul) -> Transducer:
    """The composed machine over whatever stands for factors."""
    parts = [negation_machine(3, f["negated"], one), reported_machine(f["reported"], one), target_machine(4, f["near"], one), threat_machine(4, f["intended"], one),
             insult_machine(3, f["predicated"], f["heaped"], one, times)]
    return functools.reduce(lambda a, b: a.compose(b, times), parts)


def _add(a: tuple, b: tuple) -> tuple:
    return tuple(map(operator.add, a, b))


def _tabled(m: Transducer) -> list[list[tuple]]:
    return [[m.table[s, x] for x in SYMBOLS] for s in range(m.states)]


@functools.lru_cache(4)
def _machines(values: tuple[float, ...] | None) -> tuple[list, list]:
    """Forward and backward machines with these factors; with none, over exponents of the factors."""
    if values is None:
        one = (0,) * len(NAMES)
        f, times = {n: tuple(int(i == k) for i in range(len(NAMES))) for k, n in enumerate(NAMES)}, _add
    else:
        one, f, times = 1.0, dict(zip(NAMES, values, strict=True)), operator.mul
    return _tabled(grammar(f, one, times)), _tabled(_reach_machine(TARGET, 2, f["aimed"], one))


class Patterns(NamedTuple):
    """What labels taught beside the lexicon: pairs of words and their weights, words that are threats, words round matches and their symbols."""

    pairs: dict[str, float] = {}
    threats: frozenset[str] = frozenset()
    words: dict[str, int] = {}


class Scorer:
    """``lexicon``: prefix -> weight, whole words end in ``$``; ``curve``: bias and factors of a text's features; ``factors``: the machines'."""

    def __init__(self, lexicon: dict[str, float], curve: tuple[float, ...], factors: dict[str, float] = FACTORS, patterns: Patterns = Patterns()):
        self.lexicon, self.curve, self.factors, self.patterns = lexicon, curve, dict(factors), patterns
        self.forward, self.backward = _machines(tuple(self.factors[n] for n in NAMES))
        kinds = ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (INTENT, INTENTS), (COPULA, COPULAS))
        self.symbols = {w: (x,) for x, ws in kinds for w in ws} | {w: (TARGET, COPULA) for w in CONTRACTIONS} | dict.fromkeys("\"“”«»„", (QUOTE,))
        self.symbols = {w: (x,) for w, x in patterns.words.items()} | self.symbols
        self.threats = frozenset(THREATS)
        self.phrases: dict[str, list[tuple[list[str], int, float | str]]] = {}
        anchors = set()
        known = [(p, INSULT, "phrase") for p in INSULT_PHRASES] + [(p, THREAT, "phrase") for p in THREAT_PHRASES]
        for p, symbol, weight in known + [(p, INSULT, w) for p, w in sorted(patterns.pairs.items())]:
            self.phrases.setdefault(p.split()[0], []).append((p.split(), symbol, weight))
            anchors.add(max(p.split(), key=len))
        roots: list[str] = []
        for p in sorted({k.rstrip("$") for k in lexicon} | self.threats | anchors):
            if not roots or not p.startswith(roots[-1]):
                roots.append(p)
        self.automaton = ahocorasick.Automaton()
        for p in roots:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()

    def __reduce__(self):
        return Scorer, (self.lexicon, self.curve, self.factors, self.patterns)

    def weight(self, word: str) -> float:
        """Of the longest known prefix."""
        found = self.lexicon.get(word + "$")
        if found is not None:
            return found
        for n in range(min(len(word), LONGEST), SHORTEST - 1, -1):
            found = self.lexicon.get(word[:n])
            if found is not None:
                return found
        return 0.0

    def read(self, text: str) -> list[tuple[int, float | str, str]]:
        """Symbols of a clause, matches with their weight or the name of a fitted one, and the word or phrase of each."""
        words, out, i = _WORD.findall(text), [], 0
        while i < len(words):
            word = words[i]
            for phrase, symbol, weight in self.phrases.get(word, ()):
                if words[i : i + len(phrase)] == phrase:
                    out.append((symbol, weight, " ".join(phrase)))
                    i += len(phrase)
                    break
            else:
                i += 1
                if word in self.threats:
                    out.append((THREAT, "threat", word))
                elif (known := self.symbols.get(word)) is not None:
                    out += [(x, 0.0, word) for x in known]
                elif (w := self.weight(word)) > 0:
                    out.append((THREAT if word in self.patterns.threats else INSULT, w, word))
                else:
                    out.append((OTHER, 0.0, word))
        return out

    def rewrite(self, text: str) -> list[tuple[int, float | str]]:
        """Symbols and weights of a clause."""
        return [(x, w) for x, w, _ in self.read(text)]

    def contexts(self, text: str | None) -> tuple[str, int, list[tuple[str, str]]] | None:
        """Of a text with matches: its heaviest match, a mark that names the clauses that match, and ``kind, word`` of the unknown words that stand
        round every match: ``near`` (3 before), ``before`` (in the clause), ``after`` (2 after); and of the insults that a verb of intent announces or not."""
        sets: dict[str, set[str]] = {}
        insults, mark, top = set(), 0, (0.0, "")
        for c in self.clauses(text):
            found = self.read(c)
            at = [i for i, (_, w, _) in enumerate(found) if w]
            if not at:
                continue
            mark = zlib.crc32(c.encode("utf-8", "replace"), mark)
            spans = [("before", 0, at[0])] + [s for i in at for s in (("near", max(0, i - 3), i), ("after", i + 1, i + 3))]
            for kind, a, b in spans:
                here = {v for x, _, v in found[a:b] if x == OTHER}
                sets[kind] = sets[kind] & here if kind in sets else here
            for i in at:
                weight = found[i][1]
                top = max(top, (self.factors[weight] if isinstance(weight, str) else weight, found[i][2]))
                if found[i][0] == INSULT:
                    announced = any(x == INTENT for x, _, _ in found[max(0, i - 4) : i])
                    insults.add(("announced" if announced else "plain", found[i][2]))
        return (top[1], mark, [(kind, v) for kind, vs in sets.items() for v in vs] + sorted(insults)) if sets else None

    @staticmethod
    def walk(symbols: list, forward: list, backward: list) -> list[tuple]:
        """``weight, factor from the left, factor from the right`` of each match."""
        right, state = [], 0
        for x, w in reversed(symbols):
            state, g = backward[state][x]
            right.append(g)
        out, state = [], 0
        for (x, w), g in zip(symbols, reversed(right), strict=True):
            state, f = forward[state][x]
            if w:
                out.append((w, f, g))
        return out

    def clause(self, text: str) -> float:
        return sum((self.factors[w] if isinstance(w, str) else w) * f * g for w, f, g in self.walk(self.rewrite(text), self.forward, self.backward))

    def clauses(self, text: str | None) -> list[str]:
        """The clauses in which something of the lexicon or the patterns stands."""
        if not text:
            return []
        low = text.lower().replace("’", "'")
        hits = []
        for end, n in self.automaton.iter(low):
            start = end - n + 1
            if not start or not _LETTER.match(low, start - 1):
                hits.append(start)
        out, done = [], 0
        for start in hits:
            if start < done:
                continue
            m = _CLAUSE_END.search(low, start)
            begin = max(done, *(low.rfind(c, done, start) + 1 for c in ".!?;\n"))
            done = m.start() if m else len(low)
            out.append(low[begin:done])
        return out

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Largest clause score, log of their sum, log of the clauses that match."""
        scores = [s for c in self.clauses(text) if (s := self.clause(c)) > 0]
        if not scores:
            return 0.0, 0.0, 0.0
        return max(scores), math.log1p(sum(scores)), math.log1p(len(scores))

    def exponents(self, text: str | None) -> list[list[tuple[float, list[int]]]]:
        """Of each clause that matches: a match's weight (1 where it is fitted) and the power it takes of each factor."""
        forward, backward = _machines(None)
        out = []
        for c in self.clauses(text):
            found = []
            for w, f, g in self.walk(self.rewrite(c), forward, backward):
                powers = list(_add(f, g))
                if isinstance(w, str):
                    powers[NAMES.index(w)] += 1
                found.append((1.0 if isinstance(w, str) else round(w, 6), powers))
            if found:
                out.append(found)
        return out

    def score(self, text: str | None) -> float:
        z = self.curve[0] + sum(a * b for a, b in zip(self.curve[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


SEED = ({w: 4.0 for w in SEED_INSULTS}, (-4.0, 1.0, 0.5, 0.5))


def labelled(df: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``text, toxic`` of about ``sample`` labelled rows that are not held out, written once. The sampled ids are broadcast, ``sample`` bounds them."""
    scale = 1 << 30
    usable = labels.where(F.col("toxic").isNotNull() & ~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    usable = materialize(usable, "usable-labels")
    limit = min(scale, scale * sample // max(usable.count(), 1))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(scale)) < limit)
    return materialize(df.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "labelled")


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Weights of prefixes and words from document counts. A prefix has ``SUPPORT`` toxic texts, so the sample bounds their number."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    by_word = (
        rows.select("toxic", F.explode(words).alias("w"))
        .groupBy("w").agg(F.count("*").alias("n"), F.sum("toxic").alias("pos"))
        .where(F.length("w") >= SHORTEST)
    )
    by_word = materialize(by_word, "words")
    longest = F.least(F.length("w"), F.lit(LONGEST))
    prefixes = F.concat(F.transform(F.sequence(F.lit(SHORTEST), longest), lambda k: F.substring(F.col("w"), F.lit(1), k)), F.array(F.concat("w", F.lit("$"))))
    counted = by_word.select(F.explode(prefixes).alias("p"), "n", "pos").groupBy("p").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos")).first()
    if not total["pos"] or total["pos"] == total["n"]:
        return {}
    base = math.log(total["pos"] / (total["n"] - total["pos"]))
    # a prefix worth a look is toxic far more often than the base rate; what extends it comes along as possible exceptions
    rate = total["pos"] / total["n"]
    good = counted.where((F.col("pos") >= SUPPORT) & (F.col("pos") >= (0.3 + 0.7 * rate) * F.col("n")))
    heads: list[str] = []
    for p in sorted(r["p"] for r in good.collect()):
        if not heads or not p.startswith(heads[-1]):
            heads.append(p)
    if not heads:
        return {}
    under = F.lit(False)
    for size in sorted({len(h) for h in heads}):
        under = under | F.substring("p", 1, size).isin([h for h in heads if len(h) == size])
    nodes = {r["p"]: (r["n"], r["pos"]) for r in counted.where(under & (F.col("n") >= SUPPORT)).orderBy("p").collect()}
    rest = {p: list(v) for p, v in nodes.items()}
    for p, (n, pos) in nodes.items():  # what a longer node explains no longer counts for the shorter one
        for k in range(len(p) - 1, SHORTEST - 1, -1):
            if (q := p[:k]) in nodes:
                rest[q][0] -= n
                rest[q][1] -= pos
                break
    out = {}
    for p, (n, pos) in rest.items():
        weight = math.log((max(pos, 0) + 0.5) / (max(n - pos, 0) + 0.5 + max(0, -pos))) - base if n >= 3 else None
        if weight is None:
            n, pos = nodes[p]
            weight = math.log((pos + 0.5) / (n - pos + 0.5)) - base
        out[p] = max(0.0, min(8.0, weight))
    return out


def log_odds(pos: float, n: float, base: float) -> tuple[float, float]:
    """How far ``pos`` of ``n`` moves the odds from ``base``, and the signed root of the likelihood ratio, which counts as standard errors."""
    weight, rate = math.log((pos + 0.5) / (n - pos + 0.5)) - base, 1 / (1 + math.exp(-base))
    ratio = sum(k * math.log(k / (n * r)) for k, r in ((pos, rate), (n - pos, 1 - rate)) if k)
    return weight, math.copysign(math.sqrt(max(0.0, 2 * ratio)), weight)


def word_pairs(text: str, wanted: np.ndarray | None = None):
    """Neighbouring words of a clause and a hash of the two tokens on either side; only those whose bit is set in ``wanted``, if given."""
    tokens = _TOKEN.findall(text.lower().replace("’", "'"))
    for i, (a, b) in enumerate(zip(tokens, tokens[1:], strict=False)):
        if not (a[0].isalnum() and b[0].isalnum()):
            continue
        pair = f"{a} {b}"
        if wanted is None or wanted[zlib.crc32(pair.encode("utf-8", "replace")) % PAIR_BITS]:
            yield pair, zlib.crc32(" ".join((*tokens[max(0, i - 2) : i], "|", *tokens[i + 2 : i + 4])).encode("utf-8", "replace"))


def _pair_counts(rows: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """``pair, n``: in how many different surroundings it stands."""

    def run(batches):
        kinds = {"pair": pa.string(), "around": pa.int64()}
        for b in batches:
            pairs, around = [], []
            for text in b.column(0).to_pylist():
                for p, c in word_pairs(text, wanted):
                    pairs.append(p)
                    around.append(c)
                    if len(pairs) == 100_000:
                        yield pa.RecordBatch.from_arrays([pa.array(pairs, kinds["pair"]), pa.array(around, kinds["around"])], list(kinds))
                        pairs, around = [], []
            yield pa.RecordBatch.from_arrays([pa.array(pairs, kinds["pair"]), pa.array(around, kinds["around"])], list(kinds))

    return rows.select("text").mapInArrow(run, "pair string, around long").distinct().groupBy("pair").agg(F.count("*").alias("n"))


def learn_pairs(rows: DataFrame, scorer: Scorer) -> dict[str, float]:
    """Weights of pairs of words that tell toxic texts and hold no word that matches alone. Each has ``SUPPORT`` surroundings in toxic texts, so the sample bounds them."""
    total = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("pos")).first()
    rate = total["pos"] / total["n"]
    base = math.log(rate / (1 - rate))
    often = materialize(_pair_counts(rows.where("toxic = 1")).where(F.col("n") >= SUPPORT).withColumnRenamed("n", "pos"), "toxic-pairs")
    wanted = np.zeros(PAIR_BITS, bool)
    wanted[[r[0] for r in often.select((F.crc32(F.col("pair").cast("binary")) % PAIR_BITS).cast("int")).distinct().collect()]] = True
    if not wanted.any():
        return {}
    clean = _pair_counts(rows.where("toxic = 0"), wanted).withColumnRenamed("n", "neg")
    counted = often.join(clean, "pair", "left").select("pair", "pos", (F.col("pos") + F.coalesce("neg", F.lit(0))).alias("n"))
    out = {}
    for r in counted.where(F.col("pos") >= (0.3 + 0.7 * rate) * F.col("n")).orderBy("pair").collect():
        weight, sure = log_odds(r["pos"], r["n"], base)
        words = r["pair"].split(" ")
        alone = any(w in scorer.threats or w not in scorer.symbols and scorer.weight(w) > 0 for w in words)
        if sure >= SURE and not alone and any(len(w) >= SHORTEST and w not in scorer.symbols for w in words):
            out[r["pair"]] = min(8.0, weight)
    return out


def learn_context(rows: DataFrame, scorer: Scorer) -> Patterns:
    """``scorer``'s patterns with threats and words round matches, each with ``SUPPORT`` texts of the sample.

    A word is held against what the matches beside it let expect (each text's heaviest match, as often as it stands in toxic texts), so
    that the words of a language in which matches mean less do not pass for context.
    """

    def run(batches):
        names = ["top", "kind", "word", "mark", "toxic"]
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if found := scorer.contexts(text):
                    top, mark, seen = found
                    kinds, words = zip(*seen, ("match", ""), strict=True)
                    n = len(kinds)
                    yield pa.RecordBatch.from_arrays([pa.array([top] * n), pa.array(kinds), pa.array(words), pa.array([mark] * n), pa.array([int(toxic > 0)] * n, pa.int32())], names)

    seen = materialize(rows.select("text", "toxic").mapInArrow(run, "top string, kind string, word string, mark long, toxic int").distinct(), "contexts")
    rates = seen.where("kind = 'match'").groupBy("top").agg(F.avg("toxic").alias("rate"))
    counted = seen.where("kind <> 'match'").join(rates, "top").groupBy("kind", "word").agg(F.count("*").alias("n"), F.sum("toxic").alias("pos"), F.sum("rate").alias("expected"))
    found = {(r["kind"], r["word"]): (r["n"], r["pos"], r["expected"]) for r in counted.where(F.col("n") >= SUPPORT).orderBy("kind", "word").collect()}
    best: dict[str, tuple[float, int]] = {}
    for kind, lowered, raised in (("near", NEGATION, TARGET), ("before", REPORT, None), ("after", None, TARGET)):
        for (k, word), (n, pos, expected) in found.items():
            if k == kind and len(word) > 1:
                _, sure = log_odds(pos, n, math.log((expected + 0.5) / (n - expected + 0.5)))
                symbol = lowered if sure < 0 else raised
                if symbol is not None and abs(sure) >= SURE and abs(sure) > best.get(word, (0.0, 0))[0]:
                    best[word] = abs(sure), symbol
    threats = {w for (k, w), (n, *_) in found.items() if k == "announced" and " " not in w and n >= found.get(("plain", w), (0,))[0]}
    return scorer.patterns._replace(threats=frozenset(threats), words={w: x for w, (_, x) in sorted(best.items())})


class Sample:
    """Matches of labelled texts, and the likelihood of the labels under factors and the best curve."""

    def __init__(self, rows: list[tuple[int, list, int]]):
        self.y = np.array([t > 0 for t, _, _ in rows], float)
        self.n = np.array([n for _, _, n in rows], float)
        clause, text, base, powers, k = [], [], [], [], 0
        for i, (_, clauses, _) in enumerate(rows):
            for found in clauses:
                text.append(i)
                for w, e in found:
                    clause.append(k)
                    base.append(w)
                    powers.append(e)
                k += 1
        self.clause, self.text = np.array(clause, np.int64), np.array(text, np.int64)
        self.base, self.powers = np.array(base, float), np.array(powers, float).reshape(-1, len(NAMES))

    def features(self, factors: np.ndarray) -> np.ndarray:
        scores = np.bincount(self.clause, self.base * np.exp(self.powers @ np.log(factors)), len(self.text))
        most = np.zeros(len(self.y))
        np.maximum.at(most, self.text, scores)
        return np.stack([np.ones(len(self.y)), most, np.log1p(np.bincount(self.text, scores, len(self.y))), np.log1p(np.bincount(self.text, scores > 0, len(self.y)))], axis=1)

    def curve(self, factors: np.ndarray) -> tuple[np.ndarray, float]:
        """The logistic curve by Newton's method, lightly shrunk, and its penalised log-likelihood."""
        x, y, n = self.features(factors), self.y, self.n
        w = np.zeros(4)
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + 0.1 * np.eye(4), x.T @ (n * (y - p)) - 0.1 * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        z = np.clip(x @ w, -30, 30)
        return w, float((n * (y * z - np.logaddexp(0, z))).sum() - 0.05 * (w @ w))

    def fit(self) -> tuple[np.ndarray, dict[str, float]]:
        """Curve and factors: one pass over the factors, each at the best of a few multiples of its default."""
        start = np.array([FACTORS[n] for n in NAMES])
        best = start.copy()
        w, value = self.curve(best)
        for k in range(len(NAMES)):
            if not len(self.powers) or not self.powers[:, k].any():
                continue
            for m in _STEPS:
                tried = best.copy()
                tried[k] = start[k] * m
                w2, found = self.curve(tried)
                found -= (np.log(tried / start) ** 2).sum()
                if found > value + 1e-9:
                    best, w, value = tried, w2, found
        return w, dict(zip(NAMES, best.tolist(), strict=True))


def fit(df: DataFrame, labels: DataFrame, sample: int = SAMPLE, learn_patterns: bool = True) -> Scorer:
    """Lexicon, patterns, factors and curve of the labelled texts of ``df``; without ``learn_patterns`` the fixed patterns alone stand beside the lexicon."""
    spark = df.sparkSession
    bounded_batches(spark)
    rows = labelled(df, labels, sample)
    kinds = rows.agg(F.min("toxic"), F.max("toxic")).first()
    if kinds[0] is None or kinds[0] == kinds[1]:
        return Scorer(*SEED)
    lexicon, curve = learn_lexicon(rows), (0.0, 0.0, 0.0, 0.0)
    scorer = Scorer(lexicon, curve)
    if learn_patterns:
        scorer = Scorer(lexicon, curve, patterns=Patterns(pairs=learn_pairs(rows, scorer)))
    if not lexicon and not scorer.patterns.pairs:
        return Scorer(*SEED)
    if learn_patterns:
        scorer = Scorer(lexicon, curve, patterns=learn_context(rows, scorer))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([json.dumps(scorer.exponents(t)) for t in b.column(0).to_pylist()], pa.string())], ["toxic", "found"])

    # texts with the same matches are counted together; never more rows than the sample
    found = rows.mapInArrow(run, "toxic int, found string").groupBy("toxic", "found").count().orderBy("toxic", "found").collect()
    curve, factors = Sample([(r["toxic"], json.loads(r["found"]), r["count"]) for r in found]).fit()
    return Scorer(lexicon, tuple(curve.tolist()), factors, scorer.patterns)


def score(df: DataFrame, scorer: Scorer, *, text_col: str = "text") -> DataFrame:
    """``df``'s columns but the text and one of the result's name, with ``score``."""
    bounded_batches(df.sparkSession)
    rest = [c for c in df.columns if c not in (text_col, "score")]
    rows = df.select(text_col, *rest)
    kinds = dict(rows.dtypes)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([scorer.score(t) for t in b.column(0).to_pylist()], pa.float64())], [*rest, "score"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in rest) + ", score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = documents(spark, sf_dir)
    scorer = fit(df, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(df.select("doc_id", "text"), scorer)
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Plain versions that the tests of this folder hold the operators against."""

import collections
import math
import re

import regex
import xxhash

from sheaf.llm import lines, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    t = text or ""
    words = WORD.findall(t)
    windows = collections.Counter(zip(words, words[1:], words[2:]))  # noqa: B905
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    found = [x for x in t.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(found) - len(set(found)), len(covered), len(regex.findall(r"\p{Lu}", t)), len(regex.findall(r"\p{L}", t)), len(found)


def naive_lines(texts, groups=None):
    """Removed ranges by a walk in order of ids, with chunks by their bytes; documents of a group (id -> group) count as one."""
    seen, out = {}, {}
    for i, t in texts:
        gone, mine = [], set()
        g = (groups or {}).get(i, ("alone", i))
        if t:
            all_lines = t.split("\n")
            first, n, _, _ = lines.chunks(t)
            for a, k in zip(first.tolist(), n.tolist(), strict=True):
                key = "\n".join(all_lines[a : a + k])
                if seen.setdefault(key, g) != g or key in mine:
                    gone.append((a, k))
                mine.add(key)
        out[i] = gone
    return out


def cut(text, gone):
    """A text without the ranges of lines; empty if no word is left of a text that loses some."""
    if not gone:
        return text
    left = [x for k, x in enumerate(text.split("\n")) if not any(a <= k < a + n for a, n in gone)]
    return "\n".join(left) if any(WORD.search(x) for x in left) else ""


def naive_join(texts):
    """Set sizes, components and link counts by comparing every pair."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent, links = list(range(len(sets))), [0] * len(sets)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                links[i] += 1
                links[j] += 1
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return [(len(s), find(i), links[i]) for i, s in enumerate(sets)]


# --- language -------------------------------------------------------------------------------------------------------

def ranked_grams(counter, most=300):
    """N-grams by count, ties by length, then by code points with the word break as 0."""
    place = lambda g: (len(g), [0 if c == " " else ord(c) for c in g])
    return sorted(counter, key=lambda g: (-counter[g], place(g)))[:most]


def out_of_place(profiles, mine, worst=300):
    """Distances of ranked n-grams to each profile (language -> ranked n-grams)."""
    out = {}
    for name, profile in profiles.items():
        at = {g: k for k, g in enumerate(profile)}
        out[name] = sum(abs(at[g] - k) if g in at else worst for k, g in enumerate(mine))
    return out


# --- order minhash --------------------------------------------------------------------------------------------------

def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def xx(*values):
    """The hash of strings and numbers one after the other (``None`` is left out), as a signed 64-bit number."""
    h = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else v[0].to_bytes(4, "little") if isinstance(v, tuple) else (v % (1 << 64)).to_bytes(8, "little")
            h = xxhash.xxh64_intdigest(data, seed=h)
    return _signed(h)


def order_minhash(text):
    """Entries of a text: occurrence-numbered k-mers, the two least of each of 64 bins, in text order."""
    t = text or ""
    position = (1 << 30) - 1
    words = re.findall(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1,16}(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D]", t)

    def numbered(symbols):
        n, seen, out = len(symbols), collections.Counter(), []
        hashes = [xx(s) for s in symbols]
        for p in range(max(n - 2, min(n, 1))):
            h = xx(*hashes[p : p + 3])
            k, seen[h] = seen[h], seen[h] + 1
            out.append((h if not k else xx(h, (k,)), p))
        return [(x & ~position) | p for x, p in out]

    bin_of = lambda x: (x >> 58) + 32
    bounds = [round(8 * 8 ** (b / 63)) for b in range(64)]
    chosen = [x for x in numbered(words) if bounds[bin_of(x)] <= len(words)]
    if len(words) < 64:
        chosen += [x for x in numbered([c for w in WORD.findall(t) for c in w]) if bounds[bin_of(x)] > len(words)]
    bins = collections.defaultdict(list)
    for x in sorted(chosen):
        bins[bin_of(x)].append(x)
    out = []
    for b in sorted(bins):
        two = sorted(bins[b][:2], key=lambda x: x & position)
        out.append((b << 16) + (xx(*(x >> 30 for x in two)) & 0xFFFF))
    return out


def alike(a, b):
    bins = {x >> 16 for x in a} | {x >> 16 for x in b}
    return len(set(a) & set(b)) / len(bins) if bins else 1.0


# --- toxicity -------------------------------------------------------------------------------------------------------

def plain_toxicity(s, text):
    """A scorer's result by the grammar's definitions: contexts are looked up around each match, no transducer runs."""
    names = {w: (k,) for k, ws in (("T", toxicity.TARGETS), ("N", toxicity.NEGATIONS), ("R", toxicity.REPORTS), ("W", toxicity.INTENTS), ("C", toxicity.COPULAS)) for w in ws}
    names |= {w: ("T", "C") for w in toxicity.CONTRACTIONS} | {c: ("Q",) for c in "\"“”«»„"}
    names = {w: ("OIVTNRQWC"[x],) for w, x in s.patterns.words.items()} | names
    phrases = [(p.split(), k, s.factors["phrase"]) for k, ps in (("I", toxicity.INSULT_PHRASES), ("V", toxicity.THREAT_PHRASES)) for p in ps]
    phrases += [(p.split(), "I", w) for p, w in s.patterns.pairs.items()]

    def weight(w):
        if w + "$" in s.lexicon:
            return s.lexicon[w + "$"]
        return next((s.lexicon[w[:n]] for n in range(min(len(w), 16), 2, -1) if w[:n] in s.lexicon), 0.0)

    def clause(c):
        words, seq = re.findall(r"[^\W_]+(?:'[^\W_]+)*|[\"“”«»„]", c), []
        while words:
            hit = next((x for x in phrases if words[: len(x[0])] == x[0]), None)
            if hit:
                seq.append(hit[1:])
                words = words[len(hit[0]) :]
                continue
            w, words = words[0], words[1:]
            if w in toxicity.THREATS:
                seq.append(("V", s.factors["threat"]))
            elif w in names:
                seq += [(k, 0.0) for k in names[w]]
            else:
                seq.append(("V" if w in s.patterns.threats else "I", weight(w)) if weight(w) > 0 else ("O", 0.0))
        kinds = [k for k, _ in seq]
        within = lambda k, i, n: k in kinds[max(0, i - n) : i]
        said = lambda c: "T" in kinds[max(0, c - 2) : c] or any(kinds[d] == "C" and "T" not in kinds[d:c] and said(d) for d in range(max(0, c - 3), c))
        total = 0.0
        for i, (k, w) in enumerate(seq):
            if not w:
                continue
            f = s.factors
            w *= f["negated"] if within("N", i, 3) else 1
            w *= f["reported"] if "R" in kinds[:i] or kinds[:i].count("Q") % 2 else 1
            w *= f["near"] if within("T", i, 4) else 1
            w *= f["aimed"] if "T" in kinds[i + 1 : i + 3] else 1
            w *= f["intended"] if k == "V" and within("W", i, 4) else 1
            w *= f["heaped"] if k == "I" and within("I", i, 2) else 1
            w *= f["predicated"] if k == "I" and any(kinds[c] == "C" and "T" not in kinds[c:i] and said(c) for c in range(max(0, i - 3), i)) else 1
            total += w
        return total

    scores = [x for c in re.split(r"[.!?;\n]", (text or "").lower().replace("’", "'")) if (x := clause(c)) > 0]
    x = (max(scores), math.log1p(sum(scores)), math.log1p(len(scores))) if scores else (0, 0, 0)
    z = s.curve[0] + sum(a * b for a, b in zip(s.curve[1:], x, strict=True))
    return 1 / (1 + math.exp(-max(-30, min(30, z))))

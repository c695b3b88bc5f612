"""Secret scans: three fixed formats, and formats learned from labelled credentials by merging prefix-tree states."""

import math
import re
import string
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import WordTable, fit_in_task, fresh, per_text

#: Fixed formats in the order that spans of equal starts are listed in: kind, pattern, group, least length of the group.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
LEARNED = "format"
KINDS = [kind for kind, *_ in BASE] + [LEARNED]
#: Tokens that are scored, all of them, and the shortest labelled value: no full stop at the end, 6 characters.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{4,}[A-Za-z0-9+/_=-]")
#: Documents with credentials, and documents without, that the automata are learned from, at most.
SAMPLE_ROWS = 3000
#: Confidence parameter of the merge test, and the least labelled values that make a format.
ALPHA, LEAST_VALUES = 0.05, 8
#: Weight of an event that a state never saw, and how many kinds of events a state has: eleven symbols and the end.
UNSEEN, EVENTS = 0.1, 12
#: One ordinary token in FOLDS is held out of their automaton and tests the thresholds.
FOLDS = 4
#: Share of ordinary tokens that may pass as secrets, by the bound that a likelihood ratio exceeds r with probability 1 / r.
FALSE_RATE = 1e-6
#: Longest value or token that an automaton is learned from; candidates of any length are scored.
LONGEST = 512
#: Longest candidate whose verdict a worker keeps.
KEPT_LENGTH = 64
OUTPUT = "n_assign bigint, n_access bigint, n_hex bigint, spans array<struct<kind:string,start:int,end:int>>"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed formats, leftmost first and without overlaps within a kind."""
    found = []
    for kind, pattern, group, least in BASE:
        found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


CLASSES = str.maketrans({c: "0" if c.isdigit() else "a" if "a" <= c <= "f" else "z" if c.islower() else "F" if "A" <= c <= "F" else "Z"
                         for c in string.ascii_letters + string.digits})


def symbols(value: str) -> str:
    """Characters by class, as formats are made of them: digit 0, a-f a, other lower z, A-F F, other upper Z, the rest as is."""
    return value.translate(CLASSES)


class Automaton:
    """A probabilistic automaton inferred from strings by state merging.

    The prefix tree counts how many strings pass and end at each state.  States are merged where their endings and
    arcs, all the way down, have compatible frequencies by Hoeffding's bound: first states of one depth, which pools
    the thin branches of a format of a fixed length into a chain, then, breadth first, states of all depths, which
    makes loops of lengths that vary.  Two states that only a few strings reach cannot differ by the bound, so
    without the first step every tree would fold into its root.
    """

    def __init__(self, strings):
        self.passed, self.ended, self.arcs, self.counts = [0], [0], [{}], [{}]
        for s in strings:
            at = 0
            self.passed[0] += 1
            for c in s:
                to = self.arcs[at].get(c)
                if to is None:
                    to = self.arcs[at][c] = len(self.passed)
                    self.passed.append(0)
                    self.ended.append(0)
                    self.arcs.append({})
                    self.counts.append({})
                self.counts[at][c] = self.counts[at].get(c, 0) + 1
                self.passed[to] += 1
                at = to
            self.ended[at] += 1
        self.same, self.different = list(range(len(self.passed))), set()
        self.spread = math.sqrt(0.5 * math.log(2 / ALPHA))
        self.merge_depths()
        self.merge_all()

    def state(self, q):
        """The state that q has been merged into."""
        while self.same[q] != q:
            self.same[q] = self.same[self.same[q]]
            q = self.same[q]
        return q

    def compatible(self, q, r):
        stack, asked = [(q, r, None)], {}
        while stack:
            q, r, pair = stack.pop()
            q, r = self.state(q), self.state(r)
            if q == r or (q, r) in asked:
                continue
            asked[q, r] = pair
            n1, n2 = self.passed[q], self.passed[r]
            bound = self.spread * (n1 ** -0.5 + n2 ** -0.5)
            if bound >= 1:  # No two frequencies differ by more, here or further down.
                continue
            one, two = self.counts[q], self.counts[r]
            if (q, r) in self.different or abs(self.ended[q] / n1 - self.ended[r] / n2) > bound or any(
                    abs(one.get(c, 0) / n1 - two.get(c, 0) / n2) > bound for c in one.keys() | two.keys()):
                # All pairs that led here differ too, until a merge changes their counts.
                pair = q, r
                while pair:
                    self.different.add(pair)
                    pair = asked[pair]
                return False
            stack += [(self.arcs[q][c], self.arcs[r][c], (q, r)) for c in one.keys() & two.keys()]
        return True

    def merge(self, q, r):
        """Makes r, and what follows it, one with q and what follows q."""
        self.different.clear()
        stack = [(q, r)]
        while stack:
            q, r = stack.pop()
            q, r = self.state(q), self.state(r)
            if q == r:
                continue
            self.same[r] = q
            self.passed[q] += self.passed[r]
            self.ended[q] += self.ended[r]
            for c, n in self.counts[r].items():
                self.counts[q][c] = self.counts[q].get(c, 0) + n
                if c in self.arcs[q]:
                    stack.append((self.arcs[q][c], self.arcs[r][c]))
                else:
                    self.arcs[q][c] = self.arcs[r][c]

    def merge_depths(self):
        level = [0]
        while level:
            below = {self.state(s) for q in level for s in self.arcs[q].values()}
            level = []
            for s in sorted(below, key=lambda s: (-self.passed[s], s)):
                known = next((k for k in level if self.compatible(k, s)), None)
                if known is None:
                    level.append(s)
                else:
                    self.merge(known, s)

    def merge_all(self):
        kept = [0]
        while True:
            # A merge may change any arc, so what follows the kept states is looked up anew.
            kept = list(dict.fromkeys(map(self.state, kept)))
            after = {self.state(s) for q in kept for s in self.arcs[q].values()} - set(kept)
            if not after:
                break
            s = min(after, key=lambda s: (-self.passed[s], s))
            known = next((k for k in kept if self.compatible(k, s)), None)
            if known is None:
                kept.append(s)
            else:
                self.merge(known, s)
        place = {q: i for i, q in enumerate(kept)}
        self.table = [self.row(q, place) for q in kept]
        del self.passed, self.ended, self.arcs, self.counts, self.same, self.different

    def row(self, q, place):
        """symbol -> (next state, log-probability); "" is the end where it was seen, None any other event.

        A symbol that the state never saw goes where most of its strings go.
        """
        whole = self.passed[q] + UNSEEN * EVENTS
        logs = {c: (place[self.state(self.arcs[q][c])], math.log((n + UNSEEN) / whole)) for c, n in self.counts[q].items()}
        most = max(self.counts[q], key=lambda c: (self.counts[q][c], c), default=None)
        logs[None] = (place[q] if most is None else logs[most][0], math.log(UNSEEN / whole))
        if self.ended[q]:
            logs[""] = (None, math.log((self.ended[q] + UNSEEN) / whole))
        return logs


def likelihood(table: list[dict], value: str, must_end=False) -> float:
    """Log-likelihood of a string and its end; with `must_end`, minus infinity where no learned string ended."""
    total, at = 0.0, 0
    for c in value:
        row = table[at]
        at, x = row.get(c) or row[None]
        total += x
    if "" in table[at]:
        return total + table[at][""][1]
    return -math.inf if must_end else total + table[at][None][1]


def labelled(text: str):
    """(values of the fixed formats, other candidates) of a text, without full stops at the end."""
    spans = base_spans(text)
    values = [m.group(group).rstrip(".") for _, pattern, group, least in BASE for m in pattern.finditer(text)
              if m.end(group) - m.start(group) >= least]
    return ([v for v in values if len(v) >= 6],
            [m.group() for m in CANDIDATE.finditer(text) if not any(s < m.end() and m.start() < e for s, e, _ in spans)])


def fit(texts: list[str], labels: list[str]) -> dict:
    """Automata of the formats of labelled credentials and of ordinary tokens, with a threshold for each format.

    Values are one format if they are made of the same classes of letters and digits; those of a set with fewer than
    LEAST_VALUES lack a class by chance and join the largest wider set, if there is one.  A format's threshold is what
    FALSE_RATE asks for, at least the odds of an ordinary token to a labelled value; where more held-out ordinary tokens
    pass than there are labelled values, it is the gain that leaves few enough.  So a format that ordinary documents
    are full of is none, but some credentials that nobody labelled do not hide the others.
    """
    values, plain = set(), set()
    for text in texts:
        one, two = labelled(text)
        values.update(v for v in one if len(v) <= LONGEST)
        plain.update(v for v in two if len(v) <= LONGEST)
    plain -= values
    kept = lambda v: zlib.crc32(v.encode()) % FOLDS != 0
    ordinary = Automaton(map(symbols, filter(kept, sorted(plain)))).table
    groups = {}
    for v in map(symbols, sorted(values)):
        groups.setdefault(frozenset(v) & frozenset("0azFZ"), []).append(v)
    for name in sorted((n for n, g in groups.items() if len(g) < LEAST_VALUES), key=sorted):
        wider = [n for n, g in groups.items() if n > name and len(g) >= LEAST_VALUES]
        if wider:
            groups[max(wider, key=lambda n: (len(groups[n]), sorted(n)))] += groups[name]
    tests = Counter(symbols(v) for v in plain if not kept(v))
    explained = {s: likelihood(ordinary, s) for s in tests}
    formats = []
    for strings in (groups[n] for n in sorted(groups, key=sorted) if len(groups[n]) >= LEAST_VALUES):
        learned = {"alphabet": set().union(*strings), "table": Automaton(strings).table}
        reached = sorted(((gain(learned, s, explained[s]), n) for s, n in tests.items()), reverse=True)
        threshold, passed = max(-math.log(FALSE_RATE), math.log(max(len(plain), 1) / len(strings))), 0
        for x, n in reached:
            passed += FOLDS * n
            if passed > len(strings):
                threshold = max(threshold, x)
                break
        formats.append({**learned, "threshold": threshold})
    return {"formats": formats, "plain": ordinary}


def gain(learned: dict, value: str, ordinary: float) -> float:
    """Log-likelihood ratio of a format to ordinary tokens; minus infinity outside the format's characters and endings."""
    if not learned["alphabet"].issuperset(value):
        return -math.inf
    return likelihood(learned["table"], value, must_end=True) - ordinary


def is_secret(model: dict, value: str) -> bool:
    """True where a learned format explains a candidate (as `symbols`) better than ordinary tokens, beyond its threshold."""
    fitting = [f for f in model["formats"] if f["alphabet"].issuperset(value)]
    if not fitting:
        return False
    ordinary = likelihood(model["plain"], value)
    return any(gain(f, value, ordinary) > f["threshold"] for f in fitting)


def scanner(model: dict):
    """Function from texts to [counts of the fixed kinds, all spans], for `per_text`."""
    known = WordTable(lambda s: is_secret(model, s))

    def one(text):
        spans = base_spans(text)
        counts = [sum(k == kind for *_, k in spans) for kind, *_ in BASE]
        for m in CANDIDATE.finditer(text):
            s = symbols(m.group())
            if (known[s] if len(s) <= KEPT_LENGTH else is_secret(model, s)) and not any(s < m.end() and m.start() < e for s, e, _ in spans):
                spans.append((m.start(), m.end(), LEARNED))
        spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
        return *counts, [{"kind": k, "start": s, "end": e} for s, e, k in spans]

    def work(texts):
        made = [one(t or "") for t in texts]
        return [list(c) for c in zip(*made)] if made else [[], [], [], []]

    return work


def learn(docs: DataFrame, rows=SAMPLE_ROWS) -> dict:
    """Automata of at most `rows` documents with credentials and as many without, chosen by hash of their ids.

    Documents that hold a fixed format are the labelled credentials; their other tokens, and those of documents
    without one, are ordinary.
    """
    has = F.col("text").rlike(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}|(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6}")
    marked = docs.where("doc_id IS NOT NULL").select("doc_id", "text", has.alias("has"))
    chosen = [marked.where(F.col("has") == want).select("doc_id", F.lit(label).alias("label")).distinct()
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for want, label in ((True, "with"), (False, "without"))]
    found = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    return fit_in_task(found.groupBy("doc_id", "label").agg(F.min("text").alias("text")), fit)


def scan(docs: DataFrame, model: dict, keep=("doc_id",)) -> DataFrame:
    """Columns `keep`, counts of the fixed kinds, and spans (kind, start, end in code points) of all kinds by start.

    Learned spans never overlap fixed ones, which all stay.  Null and empty texts have none; repeated rows are
    scanned one by one; ids may be null; columns other than `keep` and `text` are not looked at.
    """
    return per_text(docs, list(keep), lambda: scanner(model), OUTPUT)


def joined(spans: str):
    """kind:start:end of an array of spans, joined by commas."""
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secrets(docs: DataFrame, rows=SAMPLE_ROWS) -> DataFrame:
    """doc_id, counts, base_sha256 (of the fixed kinds' spans) and spans of every document."""
    found = scan(docs, learn(docs, rows))
    found = found.withColumn("base", F.filter("spans", lambda s: s["kind"] != LEARNED))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined("base"), 256).alias("base_sha256"),
                        joined("spans").alias("spans"))


def redact(docs: DataFrame, model: dict, mark="[secret]") -> DataFrame:
    """`docs` with every span of a secret replaced by `mark`, overlapping spans as one; n_chars follows the text."""
    scan_texts = scanner(model)

    def start():
        def one(text, spans):
            if not spans:
                return text
            out, at = [], 0
            for s in spans:
                if s["start"] >= at:
                    out += [text[at:s["start"]], mark]
                at = max(at, s["end"])
            return "".join(out) + text[at:]

        def work(texts):
            return [pa.array([one(t, s) for t, s in zip(texts, scan_texts(texts)[3])], pa.string())]
        return work

    kept = docs.columns
    clean = fresh("clean", kept)
    done = per_text(docs, kept, start, f"{clean} string").withColumn("text", F.col(clean)).drop(clean)
    if "n_chars" in kept:
        done = done.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return done.select(*kept)

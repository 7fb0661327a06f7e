"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier on its posterior labels.

1. Lexicons: hand-made word lists, and lists learned from labelled documents (words and stems that stand in far more toxic than
   clean ones; of near copies one is counted), cut into LEARNED lists by how certain they are. The fit reads at most LABELLED documents a label, by hash order.
2. Voters: each list, how often and how densely lists hit, address in the second person, and patterns of form vote toxic, clean or
   abstain on each whole text. One pass over all documents writes votes and hit words, a few bytes a document.
3. Label model: the class of a document is hidden; votes depend on it and, for correlated voters, on one another along a tree
   (the spanning tree of greatest mutual information given the class). Expectation maximisation estimates how accurate and how
   correlated voters are, from counts of vote patterns over all documents, summed by Spark. A given label is one more
   voter, which is trusted but may be wrong; held-out rows have none.
4. Classifier: logistic regression on votes and hit words against the posterior, by Newton steps, over at most SAMPLE documents
   outside the held-out fold; the rarer class and the other are half each and weighted back.

Defined cases: a null text is empty; an empty text has a score. Labels of a document are averaged (half and more is toxic), those without
doc_id or value are ignored. Without any label the label model starts from the lists alone. Repeated rows score alike; extra
columns are ignored. labels, lang, source and doc_id are no inputs of a score. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.common import materialize, sliced

FOLDS, HELD_OUT = 5, 0
#: Bounds of what is fitted: labelled documents a label for the word lists, documents for the classifier.
LABELLED, SAMPLE = 100_000, 20_000
#: Learned lists and the most entries in all of them; an entry's least log-likelihood ratio, and how much likelier it must be in toxic texts.
LEARNED, WORDS, LEAST_RATIO, TIMES = 8, 400, 20.0, 4.0
#: Of the entries in toxic documents, so many of the most frequent are counted in clean ones too. Lengths of stems.
CANDIDATES, STEMS = 100_000, range(4, 9)
ROUNDS = 12
#: The label voter's accuracy stays between these.
TRUST = (0.97, 0.999)
#: Voters that share less information (nats, given the class) count as independent.
LEAST_INFO = 0.002

# Words of abuse by list.
LISTS = {
    "person_en": "idiot idiots moron morons fool fools loser losers clown clowns jerk jerks dumbass imbecile retard bastard bitch asshole dickhead scumbag",
    "contempt_en": "stupid dumb pathetic worthless disgusting trash garbage scum vermin filth filthy useless ugly brainless hideous vile crap shit",
    "threat_en": "hate kill murder strangle",
    "de": "idiot idioten trottel dummkopf arschloch abschaum versager schwachkopf vollidiot hurensohn wichser ekelhaft erbärmlich wertlos scheisse scheiße blödmann",
    "fr": "imbécile crétin connard connasse abruti débile ordure salaud salope minable dégoûtant pathétique nul merde bouffon",
    "es": "idiota imbécil estúpido estúpida basura patético asqueroso inútil payaso escoria perdedor cabrón pendejo mierda gilipollas",
}
# Words that address someone.
ADDRESS = frozenset("you your yourself du dich dir dein deine tu toi ton ta vous votre tú ti usted eres".split())

_WORD = re.compile(r"[^\W\d_]+")
#: Patterns of form; three matches vote toxic.
FORMS = {
    "shouting": re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b"),
    "exclaiming": re.compile(r"[!?]{2,}"),
    "masking": re.compile(r"[^\W\d_][*@#$%&]{2,}"),
    "stretching": re.compile(r"([^\W\d_])\1{3,}"),
}
VOTERS = [*LISTS, *[f"learned_{i}" for i in range(LEARNED)], "several", "dense", "addressed", *FORMS, "no_word", "long_without", "sparse", "plain"]
CLEAN, ABSTAIN, TOXIC = 0, 1, 2
#: Fewer hits than one in so many words are sparse: learned lists then abstain, as chance puts their stems into long texts.
SPARSE = 200
_K = 3 * (len(VOTERS) + 1)  # one-hot values of all voters, the label last


def held_out():
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.pmod(F.crc32(key.cast("binary")), F.lit(FOLDS)) == HELD_OUT


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _given(labels: DataFrame) -> DataFrame:
    """(doc_id, label): one label for each labelled doc_id."""
    own = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    return own.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("label"))


# ---- learned lists ----


def _sketch(batches):
    """A key that near copies mostly share: the least checksum of three neighbouring words."""
    for batch in sliced(batches):
        keys = []
        for text in batch.column("text").to_pylist():
            ws = [w.encode() for w in words(text)]
            keys.append(min(map(zlib.crc32, map(b" ".join, zip(ws, ws[1:], ws[2:]))), default=zlib.crc32(b" ".join(ws))))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(keys, pa.int64())], ["doc_id", "label", "k"])


def entries(ws: set[str]) -> set[str]:
    """What a document's distinct words can be matched by: each word, `stem*` for each beginning, `stem**` for one of two words or more."""
    once: set[str] = set()
    twice: set[str] = set()
    for w in ws:
        for n in STEMS:
            if n <= len(w):
                (twice if w[:n] in once else once).add(w[:n])
    return ws | {f"{w}*" for w in once} | {f"{w}**" for w in twice}


def _frequency(only: frozenset | None):
    """In how many of a task's documents each entry stands (of `only`, if given)."""

    def flush(n):
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    def count(batches):
        n: dict[str, int] = {}
        for batch in sliced(batches):
            for text in batch.column("text").to_pylist():
                own = entries(set(words(text)))
                for w in own & only if only is not None else own:
                    n[w] = n.get(w, 0) + 1
                if len(n) > 500_000:
                    yield flush(n)
                    n = {}
        yield flush(n)

    return count


def _ratio(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> np.ndarray:
    """Log-likelihood ratio of a of na and b of nb against one common rate."""
    part = lambda x, e: np.where(x > 0, x * np.log(np.maximum(x, 1e-12) / np.maximum(e, 1e-12)), 0.0)
    p = (a + b) / (na + nb)
    return 2 * (part(a, na * p) + part(b, nb * p) + part(na - a, na * (1 - p)) + part(nb - b, nb * (1 - p)))


def learn_words(docs: DataFrame, given: DataFrame, labelled: int = LABELLED) -> tuple[list[str], set[str]]:
    """The entries that mark toxic documents, those of toxic texts alone first, WORDS at most; and hand-made words that labels speak against."""
    order = F.xxhash64("doc_id")
    sizes = {r["label"]: r["n"] for r in given.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("label") == 1, F.lit(1.5 * labelled / max(sizes.get(1, 0), 1))).otherwise(F.lit(1.5 * labelled / max(sizes.get(0, 0), 1)))
    few = given.filter(~held_out()).filter(order / 2.0**64 + 0.5 <= share)  # hashes are even: little more than the bound
    few = materialize(few.withColumn("r", F.row_number().over(W.partitionBy("label").orderBy(order, "doc_id"))).filter(F.col("r") <= labelled).select("doc_id", "label"))
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", "text")
    keyed = texts.join(F.broadcast(few), "doc_id").select("doc_id", "label", "text").mapInArrow(_sketch, "doc_id long, label int, k long")
    one = materialize(keyed.groupBy("label", "k").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "label"))
    n = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return [], set()

    def frequency(label: int, only: frozenset | None) -> DataFrame:
        chosen = texts.join(F.broadcast(one.filter(F.col("label") == label).select("doc_id").distinct()), "doc_id", "left_semi")
        return chosen.select("text").mapInArrow(_frequency(only), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))

    least = max(3, n[1] // 200)
    toxic = {r["word"]: r["n"] for r in frequency(1, None).filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(CANDIDATES).collect()}
    made = {w for ws in LISTS.values() for w in ws.split()}
    clean = {r["word"]: r["n"] for r in frequency(0, frozenset(toxic) | made).collect()}
    against = {w for w in made if clean.get(w, 0) >= 3 and toxic.get(w, 0) / n[1] < TIMES * clean[w] / n[0]}
    names = sorted(toxic)
    a, b = np.array([toxic[w] for w in names], float), np.array([clean.get(w, 0) for w in names], float)
    times = (a / n[1]) / ((b + 0.5) / n[0])
    telling = [(-g, w, t) for g, w, t in zip(_ratio(a, b, n[1], n[0]), names, times) if g >= LEAST_RATIO and t >= TIMES]
    return choose(telling), against


def choose(telling: list[tuple[float, str, float]]) -> list[str]:
    """Of (-ratio, entry, times) those that don't say the same: WORDS at most, by how much likelier they are in toxic texts."""
    stems: list[str] = []  # of `stem**`
    whole: list[str] = []
    parts: list[str] = []  # of `stem*`
    best: dict[str, float] = {}
    kind = lambda w: len(w) - len(w.rstrip("*"))
    alike = lambda a, b: a.startswith(b) or b.startswith(a)
    for _, _, _, w, t in sorted(((2, 0, 1).index(kind(w)), g, -len(w), w, t) for g, w, t in telling):
        stem = w.rstrip("*")
        if kind(w) == 2:
            same, own = any(alike(stem, v) for v in stems), stems
        elif kind(w) == 0:
            same, own = any(stem.startswith(v) for v in stems), whole
        else:
            same, own = any(alike(stem, v) for v in stems) or any(v.startswith(stem) for v in whole) or any(alike(stem, v) for v in parts), parts
        if not same and len(best) < WORDS:
            own.append(stem)
            best[w] = t
    return sorted(best, key=lambda w: (-best[w], w))


# ---- votes ----


class Voters:
    """The word lists: fixed ones by name, and LEARNED lists of learned entries, from those of toxic texts alone to the less certain."""

    def __init__(self, learned: list[str], against: set[str] = frozenset()):
        fixed = [(w, at) for at, name in enumerate(LISTS) for w in LISTS[name].split() if w not in against]
        own = [(w, len(LISTS) + i * LEARNED // len(learned)) for i, w in enumerate(learned)]
        self.names = sorted({w for w, _ in fixed + own})
        self.index = {w: i for i, w in enumerate(self.names)}
        self.lists: dict[str, list[int]] = {}
        for w, at in fixed + own:
            self.lists.setdefault(w, []).append(at)
        self.stems = {w.rstrip("*") for w in self.names if w.endswith("*")}
        self.lengths = sorted({len(w) for w in self.stems})

    def find(self, ws: set[str]) -> tuple[list[str], set[str]]:
        """The entries that a document's words match, and those words."""
        found, among = ws & self.index.keys(), {w for w in ws if w in self.index}
        if self.stems:
            under: dict[str, int] = {}
            for w in ws:
                for n in self.lengths:
                    if w[:n] in self.stems and n <= len(w):
                        under[w[:n]] = under.get(w[:n], 0) + 1
                        among.add(w)
            found |= {f"{w}*" for w in under} & self.index.keys()
            found |= {f"{w}**" for w, n in under.items() if n > 1} & self.index.keys()
        return sorted(found), among

    def vote(self, text: str | None) -> tuple[bytes, list[int]]:
        """Each voter's vote, and the numbers of the entries that were hit."""
        text = text or ""
        ws = words(text)
        own = set(ws)
        hit, among = self.find(own)
        v = bytearray([ABSTAIN]) * len(VOTERS)
        n = sum(w in among for w in ws)
        sparse = 0 < SPARSE * n < len(ws)
        for w in hit:
            for at in self.lists[w]:
                if at < len(LISTS) or not sparse:
                    v[at] = TOXIC
        at = len(LISTS) + LEARNED
        if hit:
            v[at] = TOXIC if len(among) > 1 and not sparse else ABSTAIN
            v[at + 1] = TOXIC if 100 * n >= len(ws) else ABSTAIN
            v[at + 2] = TOXIC if own & ADDRESS else ABSTAIN
        formed = [sum(1 for _ in zip(p.finditer(text), range(3))) == 3 for p in FORMS.values()]
        for i, yes in enumerate(formed):
            v[at + 3 + i] = TOXIC if yes else ABSTAIN
        if not hit:
            v[-4] = CLEAN
            v[-3] = CLEAN if len(ws) >= 200 else ABSTAIN
        v[-2] = CLEAN if sparse else ABSTAIN
        v[-1] = ABSTAIN if any(formed) else CLEAN
        return bytes(v), [self.index[w] for w in hit]


def _voting(voters: Voters):
    def vote(batches):
        for batch in sliced(batches):
            got = [voters.vote(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([v for v, _ in got], pa.binary()), pa.array([h for _, h in got], pa.list_(pa.int32()))], ["doc_id", "held_out", "votes", "hits"])

    return vote


# ---- label model ----


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


class LabelModel:
    """P(class) and P(vote | class, vote of the tree's parent) of every voter, the label last."""

    def __init__(self, pairs: np.ndarray, parent: list[int] | None = None, alpha: float = 5.0):
        """pairs[y, a, b]: how many documents of class y have the one-hot values a and b. Without parents voters are independent."""
        m = _K // 3
        self.pairs = pairs
        self.total = pairs[:, :3, :3].sum((1, 2))
        self.prior = (self.total[1] + 1) / (self.total.sum() + 2)
        own = np.stack([np.diagonal(x) for x in pairs])
        self.alone = (own + 0.5) / (own.reshape(2, m, 3).sum(2, keepdims=True).repeat(3, 2).reshape(2, _K) + 1.5)
        self.parent = parent or [-1] * m
        # log odds of a vote, by the parent's vote: a table (voter, parent's value, own value)
        self.odds = np.zeros((m, 3, 3))
        for j in range(m):
            for b in range(3):
                p1, p0 = (self._given(y, j, b, alpha) for y in (1, 0))
                self.odds[j, b] = np.log(p1) - np.log(p0)
        toxic = lambda y: float(np.clip(self.alone[y, -1] / (self.alone[y, -1] + self.alone[y, -3]), *((1 - TRUST[1], 1 - TRUST[0]) if y == 0 else TRUST)))
        on, off = toxic(1), toxic(0)
        self.odds[m - 1] = [np.log((1 - on) / (1 - off)), 0.0, np.log(on / off)]

    def tree(self) -> list[int]:
        """Each voter's parent in the spanning forest of greatest information given the class (LEAST_INFO at least); -1 for roots and the label."""
        m = _K // 3
        info = np.zeros((m, m))
        for y in (0, 1):
            q = ((self.pairs[y] + 1e-3) / max(self.total[y], 1e-9)).reshape(m, 3, m, 3).transpose(0, 2, 1, 3)
            q = q / q.sum((2, 3), keepdims=True)
            info += self.total[y] / max(self.total.sum(), 1e-9) * (q * np.log(q / (q.sum(3, keepdims=True) * q.sum(2, keepdims=True)))).sum((2, 3))
        info, m = np.round(info, 9), m - 1
        parent, best, inside = [-1] * (m + 1), [(info[0, j], 0) for j in range(m)], {0}
        while len(inside) < m:
            j = max((j for j in range(m) if j not in inside), key=lambda j: (best[j][0], -j))
            if best[j][0] >= LEAST_INFO:
                parent[j] = best[j][1]
            inside.add(j)
            best = [max(best[k], (info[j, k], j), key=lambda x: x[0]) for k in range(m)]
        return parent

    def _given(self, y: int, j: int, b: int, alpha: float) -> np.ndarray:
        alone = self.alone[y, 3 * j : 3 * j + 3]
        if self.parent[j] < 0:
            return alone
        n = self.pairs[y, 3 * j : 3 * j + 3, 3 * self.parent[j] + b]
        return (n + alpha * alone) / (n.sum() + alpha)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic) of rows of votes, the label's included."""
        x = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for j, up in enumerate(self.parent):
            x += self.odds[j, votes[:, up] if up >= 0 else 0, votes[:, j]]
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))

    def accuracies(self) -> list[tuple[str, float, float, str | None]]:
        """(voter, how often it votes, how often such a vote is right, the voter it depends on)."""
        rows = []
        for j, name in enumerate(VOTERS):
            n = self.alone[:, 3 * j : 3 * j + 3] * self.total[:, None]
            voted = n[:, CLEAN].sum() + n[:, TOXIC].sum()
            rows.append((name, float(voted / max(n.sum(), 1e-9)), float((n[0, CLEAN] + n[1, TOXIC]) / max(voted, 1e-9)), VOTERS[self.parent[j]] if self.parent[j] >= 0 else None))
        return rows


def _first_guess(votes: np.ndarray) -> np.ndarray:
    """The label where there is one; else likely toxic where a list hits."""
    hit = (votes[:, : len(LISTS) + LEARNED] == TOXIC).any(1)
    return np.where(votes[:, -1] == TOXIC, 0.95, np.where(votes[:, -1] == CLEAN, 0.05, np.where(hit, 0.8, 0.02)))


def _pair_counter(posterior):
    def count(batches):
        got = np.zeros((2, _K, _K))
        for batch in batches:
            votes = _matrix(batch.column("votes"))
            hot = np.eye(3)[votes].reshape(len(votes), -1)
            q, n = posterior(votes), batch.column("n").to_numpy().astype(float)
            got[1] += hot.T @ (hot * (n * q)[:, None])
            got[0] += hot.T @ (hot * (n * (1 - q))[:, None])
        flat = got.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], ["cell", "n"])

    return count


def fit_labels(patterns: DataFrame, rounds: int = ROUNDS) -> LabelModel | None:
    """Expectation maximisation over (votes, n): each round is one pass, summed by cell of the table of pairs.

    Half of the rounds take voters as independent; the tree is found from what they give and kept.
    """
    model, guess, parent = None, _first_guess, None
    for i in range(rounds):
        got = patterns.mapInArrow(_pair_counter(guess), "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        if not got.num_rows:
            return None
        pairs = np.zeros(2 * _K * _K)
        pairs[got.column("cell").to_numpy()] = got.column("n").to_numpy()
        last, model = model, LabelModel(pairs.reshape(2, _K, _K), parent)
        if parent is None and i + 1 >= rounds // 2:
            parent = model.tree()
            model = LabelModel(model.pairs, parent)
        elif parent is not None and abs(last.prior - model.prior) < 1e-5 * model.prior:
            break
        guess = model.posterior
    return model


# ---- classifier ----


def _features(votes: np.ndarray, hits: list[list[int]], n_words: int) -> np.ndarray:
    """One, votes for toxic, votes for clean, and the words that were hit (without the label)."""
    own = votes[:, : len(VOTERS)]
    x = np.zeros((len(votes), 1 + 2 * len(VOTERS) + n_words), np.float32)
    x[:, 0] = 1
    x[:, 1 : 1 + len(VOTERS)] = own == TOXIC
    x[:, 1 + len(VOTERS) : 1 + 2 * len(VOTERS)] = own == CLEAN
    for i, h in enumerate(hits):
        x[i, [1 + 2 * len(VOTERS) + k for k in h]] = 1
    return x


def fit_classifier(rows: DataFrame, model: LabelModel, n_words: int, sample: int = SAMPLE) -> np.ndarray:
    """Weights by Newton steps. rows: (r, votes with the label, hits, q) outside the held-out fold."""
    side = (F.col("q") >= 0.5).cast("int")
    sizes = {r["side"]: r["n"] for r in rows.groupBy(side.alias("side")).agg(F.count("*").alias("n")).collect()}
    x, q, w = [], [], []
    for at, n in sorted(sizes.items()):
        few = rows.filter((side == at) & (F.col("r") / 2.0**64 + 0.5 <= F.lit(sample / n))).orderBy("r", "votes", "hits").limit(sample // 2)
        got = few.select("votes", "hits", "q").toArrow()
        if got.num_rows:
            x.append(_features(_matrix(got.column("votes")), got.column("hits").to_pylist(), n_words))
            q.append(got.column("q").to_numpy())
            w.append(np.full(got.num_rows, n / got.num_rows))
    beta = np.zeros(1 + 2 * len(VOTERS) + n_words)
    if not x:
        return beta
    x, q, w = np.concatenate(x), np.concatenate(q), np.concatenate(w)
    w *= len(w) / w.sum()
    ridge = np.full(len(beta), 1.0)
    ridge[0] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (w * (p - q)) + ridge * beta
        bend = np.zeros((len(beta), len(beta)))
        for s in range(0, len(x), 4096):
            part = x[s : s + 4096]
            bend += part.T @ (part * (w * p * (1 - p))[s : s + 4096, None])
        step = np.linalg.solve(bend + np.diag(ridge), slope)
        beta -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _posteriors(model: LabelModel):
    def add(batches):
        for batch in batches:
            q = model.posterior(_matrix(batch.column("votes"))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("r"), batch.column("votes"), batch.column("hits"), pa.array(q)], ["r", "votes", "hits", "q"])

    return add


def _scoring(beta: np.ndarray, n_words: int):
    def score(batches):
        for batch in sliced(batches, 8192):
            if batch.num_rows:
                x = _features(_matrix(batch.column("votes")), batch.column("hits").to_pylist(), n_words) @ beta
                p = 1 / (1 + np.exp(-np.clip(x, -500, 500)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array([len(h) for h in batch.column("hits").to_pylist()], pa.int32())], ["doc_id", "held_out", "score", "predicted", "n_hits"])

    return score


class Scorer:
    """What was fitted: word lists, label model, weights."""

    def __init__(self, docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, sample: int = SAMPLE):
        given = materialize(_given(labels))
        self.voters = Voters(*learn_words(docs, given, labelled))
        self.rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(_voting(self.voters), "doc_id long, held_out boolean, votes binary, hits array<int>"))
        said = F.when(F.col("label").isNull() | F.col("held_out"), F.lit(bytes([ABSTAIN]))).when(F.col("label") == 1, F.lit(bytes([TOXIC]))).otherwise(F.lit(bytes([CLEAN])))
        told = materialize(self.rows.join(given, "doc_id", "left").select("held_out", F.xxhash64("doc_id", "votes").alias("r"), F.concat("votes", said).alias("votes"), "hits"))
        self.model = fit_labels(materialize(told.groupBy("votes").agg(F.count("*").alias("n"))))
        n = len(self.voters.names)
        self.beta = np.zeros(1 + 2 * len(VOTERS) + n)
        if self.model is not None:
            fold = told.filter(~F.col("held_out")).select("r", "votes", "hits")
            self.beta = fit_classifier(materialize(fold.mapInArrow(_posteriors(self.model), "r long, votes binary, hits array<int>, q double")), self.model, n, sample)

    def scores(self) -> DataFrame:
        """doc_id, held_out, score, predicted, n_hits (lexicon words found)."""
        return self.rows.mapInArrow(_scoring(self.beta, len(self.voters.names)), "doc_id long, held_out boolean, score double, predicted int, n_hits int")


def score(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, sample: int = SAMPLE) -> DataFrame:
    return Scorer(docs, labels, labelled, sample).scores()

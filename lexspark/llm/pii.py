"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs
them, and a span classifier trained on the outcome decides."""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.operators.lineage import settle

#: The kinds with base patterns, in order, and those that the method alone finds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
EMAIL_HOST = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
#: Runs of digits and single dots; every four groups of one are a match of the base pattern.
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Wider forms that make candidates beside the base patterns.
NAME = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++"
WIDE = {
    "email": re.compile(
        rf"{NAME} ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:[(\[]dot[)\]]|\.| dot ) ?[A-Za-z0-9-]++)+"
        rf"|{NAME} at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)+"
    ),
    "phone": re.compile(r"(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![\w-])|00[1-9][0-9]{8,12}(?!\w)"),
    "secret": re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"),
}
#: Runs of digits in groups, in looser forms than the base patterns; candidates are sub-spans at bounds of groups.
RUNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:(?:\.|\[\.\]|\(\.\)|\[dot\])[0-9]++){3,}"),
    "card": re.compile(r"[0-9](?:[ ._/\u2013\xa0-]{0,2}[0-9]){13,}+"),
    "phone": re.compile(r"\+[0-9](?:[ ().\u2013/-]{0,3}[0-9]){9,}"),
}
GROUP = re.compile("[0-9]+")
#: Least and most digits of cards and phones, and most groups of a card.
DIGITS = {"card": (14, 19), "phone": (10, 15)}
GROUPS = 7
#: Digits by group of printed cards.
GROUPINGS = frozenset([(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), (14,), (15,), (16,), (19,)])
DIGIT = re.compile("[0-9]")
#: Least length of a word with a secret in it.
LONG = 16


def may_hold(name: str, text: str) -> bool:
    """Whether a wider form or a run of this kind can occur in a text that has digits; cheap to tell."""
    if name == "email":
        return "(at)" in text or "[at]" in text or " dot " in text
    if name == "ip":
        return text.count(".") >= 3
    return name != "secret" or any(len(w) >= LONG for w in text.split())


#: Gazetteers: top-level domains, first digits of card issuers, calling codes of +numbers.
DOMAINS = frozenset("com org net edu gov mil int info biz io co de fr es it uk eu us ca ch at nl be ru jp cn in br au".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "36", "38", "6011", "65", "35", "62", "2221", "2720")
KEYS = re.compile(r"(?:token|secret|key|passwd|password|pwd|auth|bearer|credentials?|signature)[\"']?\s{0,2}[:=]?\s{0,2}[\"']?\Z", re.I)
PREFIXES = ("sk-", "pk-", "ghp_", "gho_", "xox", "AKIA", "ASIA", "AIza", "eyJ", "glpat-")
CALLING = ("1", "7", "20", "27", "3", "4", "5", "6", "81", "82", "84", "86", "9")
#: Context words looked for in the 40 characters before a span.
CONTEXT = {
    "email": re.compile(r"mail|contact|write|correo|courriel|kontakt|@", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|login|adresse", re.I),
    "card": re.compile(r"card|visa|pay|credit|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax|ruf|appel|llam", re.I),
    "secret": re.compile(r"token|secret|passw|\bkey|auth|bearer|credential|login", re.I),
}
VOTERS = ("pattern", "check", "gazetteer", "context", "shape")
#: Hashed features of the span classifier for each kind.
FEATURES = 1 << 12
DECIDE = 0.5
#: Labelers are taken to be better than chance: spans of each class that are counted beforehand, by vote (-1, 0, 1).
BEFORE = 5 * np.array([[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns' matches that pass their checks, kind by kind.

    Leftmost and non-overlapping within a kind; a match that fails its check is dropped and its
    characters are not tried again.
    """
    found: list[tuple[int, int, int]] = []
    at, floor = text.find("@"), 0
    while at >= 0:  # from each @ the name runs left and the host right
        if (name := _run(text, floor, at)) and (host := EMAIL_HOST.match(text, at + 1)):
            found.append((at - name, 0, host.end()))
            floor = host.end()
        at = text.find("@", max(at + 1, floor))
    if not DIGIT.search(text):
        return found
    for m in DOTTED.finditer(text):
        parts, begin = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            end = begin + sum(map(len, parts[k : k + 4])) + 3
            if all(map(_octet, parts[k : k + 4])):
                found.append((begin, 1, end))
            begin = end + 1
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            found.append((m.start(), 3, m.end()))
    return found


NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _run(text: str, floor: int, at: int) -> int:
    """The number of name characters right before at, down to floor."""
    start = at
    while start > floor and text[start - 1] in NAME_CHARS:
        start -= 1
    return at - start


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def luhn(digits: str) -> bool:
    double = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(double) + sum(map(int, digits[::-2]))) % 10 == 0


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, whether a base span): base spans; wider forms of email and phone; long runs of letters
    and digits for secrets; and sub-spans of runs of digits at bounds of groups, of as many digits (octets) as
    the kind has, among them those inside base matches that failed. None overlaps a base span."""
    out = [(*s, True) for s in base]
    starts, ends = [], []  # the base spans' union, in order
    for a, _, b in sorted(base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def free(a: int, b: int) -> bool:
        at = bisect(starts, a)
        return (at == 0 or ends[at - 1] <= a) and (at == len(starts) or b <= starts[at])

    digits = DIGIT.search(text)
    for name, pattern in WIDE.items():
        if (digits or name == "email") and may_hold(name, text):
            for m in pattern.finditer(text):
                if free(*m.span()) and (name != "secret" or _mixed(m.group())) and (name != "phone" or _apart(text, m.start())):
                    out.append((m.start(), KINDS.index(name), m.end(), False))
    for name, pattern in RUNS.items():
        if digits and may_hold(name, text):
            for m in pattern.finditer(text):
                out += [(a, KINDS.index(name), b, False) for a, b in _within(text, name, m.start(), m.end()) if free(a, b)]
    return out


def _apart(text: str, at: int) -> bool:
    """Whether a number is not the rest of a longer word or number."""
    return at == 0 or not (text[at - 1].isalnum() or text[at - 1] in "_+.-")


def _mixed(run: str) -> bool:
    """Whether a run has both letters and digits."""
    return any(c.isalpha() for c in run) and any(c.isdigit() for c in run)


def _within(text: str, name: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the sub-spans of a run that have a valid number of digits; of four groups for ip."""
    groups = [m.span() for m in GROUP.finditer(text, start, end)]
    if name == "ip":
        yield from ((groups[k][0], groups[k + 3][1]) for k in range(len(groups) - 3))
        return
    least, most = DIGITS[name]
    for k in range(1 if name == "phone" else len(groups)):
        n = 0
        for a, b in groups[k : k + (most if name == "phone" else GROUPS)]:
            n += b - a
            if n > most:
                break
            if n >= least:
                yield (start if name == "phone" else groups[k][0]), b


def votes(text: str, start: int, kind: int, end: int, base: bool) -> tuple[int, ...]:
    """One vote of each labeler in VOTERS: 1 personal data, -1 not, 0 no opinion."""
    span, name = text[start:end], KINDS[kind]
    digits = re.sub(r"[^0-9]", "", span)
    pattern = 1 if base else -1
    if name == "email":
        host = re.sub(r"[ \[(]+dot[ \])]+", ".", re.split(r"@|[ \[(]+at[ \])]+", span)[-1])
        tail = host.rsplit(".", 1)[-1].lower()
        check = 1 if "@" in span or "(at)" in span or "[at]" in span else -1
        gazetteer = 1 if tail in DOMAINS else -1
        shape = 1 if len(tail) >= 2 and tail.isalpha() else -1
    elif name == "ip":
        parts = GROUP.findall(span)
        pattern = 1 if base or not _numbered(text, start, end) else -1
        check = 1 if all(_octet(p) for p in parts) else -1
        gazetteer = -1 if parts[0].lstrip("0") in ("", "127") or span.startswith("0.") else 0
        shape = 1 if all(p == "0" or not p.startswith("0") for p in parts) else -1
    elif name == "card":
        pattern = 1 if base or tuple(map(len, GROUP.findall(span))) in GROUPINGS else -1
        check = 1 if luhn(digits) else -1
        gazetteer = 1 if digits.startswith(ISSUERS) else -1
        shape = 1 if len(digits) in (15, 16) else -1
    elif name == "secret":
        before = text[max(0, start - 30) : start]
        known = span.startswith(PREFIXES)
        pattern = 1 if known or re.search(r"[:=]\s*[\"']?\Z", before) else -1
        check = 1 if entropy(span) >= 3.0 and not span.isalpha() else -1
        gazetteer = 1 if known or KEYS.search(before) else -1
        shape = 1 if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", span) or (span != span.lower() and span != span.upper()) else -1
    else:
        pattern = 1 if base or span.startswith("+") else 0 if len(GROUP.findall(span)) == 3 else -1
        check = 1 if 10 <= len(digits) <= 15 else -1
        gazetteer = 1 if span.startswith("+") and digits.startswith(CALLING) else 0
        shape = 1 if re.search(r"[ ().-]", span) else -1
    context = 1 if CONTEXT[name].search(text[max(0, start - 40) : start]) else 0
    return pattern, check, gazetteer, context, shape


def entropy(span: str) -> float:
    """Bits a character by the span's own shares of characters."""
    return -sum(n / len(span) * math.log2(n / len(span)) for n in Counter(span).values())


def _numbered(text: str, start: int, end: int) -> bool:
    """Whether a dotted span goes on in digits to either side."""
    return re.search(r"[0-9]\.$", text[max(0, start - 2) : start]) is not None or re.match(r"\.?[0-9]", text[end : end + 2]) is not None


def span_features(text: str, start: int, kind: int, end: int) -> list[int]:
    """Hashed features: the span's shape, its length, first digits, and the words beside it."""
    span = text[start:end]
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "0", span))))
    before = text[max(0, start - 30) : start].lower().split()
    after = text[end : end + 30].lower().split()
    found = [f"s{shape[:40]}", f"n{min(len(span), 40)}", f"p{re.sub(r'[^0-9]', '', span)[:2]}", f"b{before[-1] if before else ''}", f"a{after[0] if after else ''}", f"t{span.rsplit('.', 1)[-1][:8].lower()}"]
    return sorted({xxhash.xxh32_intdigest(f"{kind}{f}".encode()) % FEATURES for f in found})


def estimate(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 50) -> tuple[float, np.ndarray]:
    """Expectation-maximisation over counted vote patterns: (share of true spans, reliabilities).

    reliabilities[c, v, x]: probability that voter v votes x - 1 on a span of class c. Begins at the
    share of positive votes; BEFORE tells the classes apart and keeps it defined for any counts.
    """
    vote = np.array([p for p, _ in patterns], dtype=np.int64).reshape(-1, len(VOTERS)) + 1
    n = np.array([c for _, c in patterns], dtype=float)
    truth = (vote == 2).sum(axis=1) / np.maximum((vote != 1).sum(axis=1), 1)
    truth = np.where((vote[:, 0] == 2) & (vote[:, 1] == 2), np.maximum(truth, 0.9), truth * 0.5)
    share, table = 0.5, np.zeros((2, len(VOTERS), 3))
    for _ in range(rounds):
        weight = np.stack([(1 - truth) * n, truth * n])
        share = (weight[1].sum() + 1) / (n.sum() + 2)
        for x in range(3):
            table[:, :, x] = weight @ (vote == x) + BEFORE[:, x, None]
        table /= table.sum(axis=2, keepdims=True)
        logs = np.log(table)[:, np.arange(len(VOTERS)), vote].sum(axis=2) + np.log([[1 - share], [share]])
        truth = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    return share, table


def posterior(vote: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    logs = np.log(table)[:, np.arange(len(VOTERS)), vote + 1].sum(axis=2) + np.log([[1 - share], [share]])
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


FIELDS = ("start", "kind", "stop", "base", "votes", "features")


def described(text: str, found: list[tuple[int, int, int, bool]]) -> Iterator[tuple]:
    """Candidates with their votes and features."""
    for a, k, b, own in found:
        vote = votes(text, a, k, b, own)
        yield a, k, b, own, list(vote), span_features(text, a, k, b)


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, base spans, and its candidates with votes and features."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["id"], batch["text"], strict=True):
                base = base_spans(text := text or "")
                found = [dict(zip(FIELDS, row, strict=True)) for row in described(text, candidates(text, base))]
                rows.append((doc, found))
            yield pd.DataFrame(rows, columns=["id", "found"])

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    kind = "array<struct<start:int,kind:int,stop:int,base:boolean,votes:array<int>,features:array<int>>>"
    return rows.mapInPandas(run, f"id string, found {kind}")


class SpanModel:
    """The span classifier: naive Bayes over the labelers' votes and hashed features.

    By kind: prior log odds, log odds of each vote (voter x vote + 1), log odds of features. Features of one
    span repeat each other, so their mean counts, not their sum.
    """

    def __init__(self, prior: np.ndarray, vote: np.ndarray, weights: np.ndarray) -> None:
        self.prior, self.vote, self.weights = prior, vote, weights

    def probability(self, kind: int, vote: list[int], feature: list[int]) -> float:
        odds = self.prior[kind] + self.vote[kind, np.arange(len(VOTERS)), np.array(vote) + 1].sum() + self.weights[kind][feature].mean()
        return float(1 / (1 + np.exp(-np.clip(odds, -500, 500))))


def train_spans(found: DataFrame) -> SpanModel:
    """Reliabilities from counted vote patterns, then a naive Bayes classifier on feature counts, each span
    weighed by its posterior.

    The classifier's weights of votes are the reliabilities that expectation-maximisation has found; those of features
    are learned from the posteriors. So its odds are the labelers' posterior, corrected by what spans of that
    posterior look like. It decides on all candidates but those that fail their kind's check, which accepted leaves
    out first (addresses have no check). What is collected is bounded: kinds x 3^voters patterns, kinds x FEATURES
    counts."""
    spans = found.select(F.explode("found").alias("s")).select("s.kind", "s.votes", "s.features")
    counted = spans.groupBy("kind", "votes").count().toPandas()
    shares = {}
    for kind in range(len(KINDS)):
        own = counted[counted["kind"] == kind]
        shares[kind] = estimate([(tuple(v), float(c)) for v, c in zip(own["votes"], own["count"], strict=True)]) if len(own) else estimate([])
    true, every = np.ones((len(KINDS), FEATURES)), np.full((len(KINDS), FEATURES), 2.0)
    by_feature = spans.select("kind", "votes", F.explode("features").alias("feature")).groupBy("kind", "votes", "feature").count()
    odds = F.create_map(*[x for k, v, p in _table(counted, shares) for x in (F.lit(f"{k}:{v}"), F.lit(p))]) if len(counted) else None
    if odds is not None:
        weighed = by_feature.withColumn("p", odds[F.concat_ws(":", F.col("kind").cast("string"), F.concat_ws(",", F.col("votes").cast("array<string>")))])
        sums = weighed.groupBy("kind", "feature").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("p")).alias("t")).toPandas()
        true[sums["kind"], sums["feature"]] += sums["t"]
        every[sums["kind"], sums["feature"]] += sums["n"]
    false = every - true
    weights = np.log(true / true.sum(axis=1, keepdims=True)) - np.log(false / false.sum(axis=1, keepdims=True))
    tables = np.log(np.stack([shares[k][1] for k in range(len(KINDS))]))
    share = np.array([shares[k][0] for k in range(len(KINDS))])
    return SpanModel(np.log(share) - np.log(1 - share), tables[:, 1] - tables[:, 0], weights)


def _table(counted: pd.DataFrame, shares: dict) -> list[tuple[int, str, float]]:
    return [(int(k), ",".join(map(str, v)), float(posterior(np.array([list(v)]), *shares[k])[0])) for k, v in zip(counted["kind"], counted["votes"], strict=True)]


def accepted(found: list[tuple[int, int, int, bool, list[int], list[int]]], model: SpanModel) -> list[tuple[int, int, int]]:
    """(start, kind, end) of candidates with votes and features: base spans, and of the others those that pass
    their check and the classifier, the likeliest (then longest) first where they overlap."""
    rows = [(a, k, b) for a, k, b, own, _, _ in found if own]
    more = []
    for a, k, b, own, vote, feature in found:
        if not own and (KINDS[k] == "email" or vote[1] == 1) and (p := model.probability(k, vote, feature)) >= DECIDE:
            more.append((-p, a - b, a, k, b))
    taken: list[tuple[int, int]] = []
    for _, _, a, k, b in sorted(more):
        at = bisect(taken, (a, b))
        if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
            taken.insert(at, (a, b))
            rows.append((a, k, b))
    return rows


def decide(found: DataFrame, model: SpanModel) -> DataFrame:
    """(id, base, spans): arrays of start, kind, stop; base spans always stay, others by the classifier."""
    shared = found.sparkSession.sparkContext.broadcast(model)
    kind = "array<struct<start:int,kind:int,stop:int>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            base, spans = [], []
            for found in batch["found"]:
                rows = [(s["start"], s["kind"], s["stop"]) for s in found if s["base"]]
                base.append(sorted(rows))
                spans.append(sorted(accepted([(s["start"], s["kind"], s["stop"], s["base"], list(s["votes"]), list(s["features"])) for s in found], model)))
            yield pd.DataFrame({"id": batch["id"], "base": base, "spans": spans})

    return found.mapInPandas(run, f"id string, base {kind}, spans {kind}")


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id string, base, spans) of every row of docs; null and empty texts have none.

    The candidates with votes and features are written once to the shared folder; estimation, training
    and decisions read only them. Repeated rows are judged alike; other columns are not read.
    """
    found = settle(find_candidates(docs, id_col, text_col), "candidates")
    return decide(found, train_spans(found))


def _listing(spans: str) -> F.Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))))


def document_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret and n_spans of all documents.

    Null and empty texts have no spans. Repeated rows each get a row, a null id stays null, an empty table
    gives no row. Other columns are not read."""
    rows = personal_spans(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    n = [count(k).alias(f"n_{name}") for k, name in enumerate(BASE)]
    secrets = F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index("secret"))).cast("long")
    return rows.select(
        F.col("id").cast("long").alias("doc_id"), *n, F.sha2(_listing("base"), 256).alias("base_sha256"), _listing("spans").alias("spans"),
        secrets.alias("n_secret"), F.size("spans").cast("long").alias("n_spans"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every found span of text_col replaced by its kind in brackets; null texts stay null.

    Trains on all rows first; decisions are made again on the row's own text, so no join is needed.
    """
    model = train_spans(settle(find_candidates(docs, id_col, text_col), "candidates"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        model = shared.value
        return pd.Series([_masked(t, model) for t in texts], dtype=object)

    return docs.withColumn(text_col, masked(F.col(text_col)))


def _masked(text: str | None, model: SpanModel) -> str | None:
    if not text:
        return text
    spans = accepted(list(described(text, candidates(text, base_spans(text)))), model)
    out, at = [], 0
    for a, k, b in sorted(spans, key=lambda s: (s[0], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])

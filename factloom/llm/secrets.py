"""Secret scans: candidates by patterns, false positives removed by a random forest."""

from __future__ import annotations

import base64
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import table

#: Words beside a secret and beside public numbers, words in samples, and paths that hold examples.
KEYWORDS = "token secret password passwd pwd apikey api_key key auth bearer credential credentials private access".split()
PUBLIC = "sha sha1 sha256 md5 checksum digest commit uuid guid hash revision etag isbn color id ref version".split()
SAMPLES = "example sample dummy placeholder changeme your xxxx test fake todo redacted".split()
EXAMPLE_PATHS = "test tests example examples doc docs fixture fixtures sample mock".split()
#: Formats that issuers publish.
FORMATS = {
    "aws_key_id": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[0-9A-Za-z]{36,}\b",
    "slack_token": r"\bxox[abprs]-[0-9A-Za-z-]{10,}\b",
    "stripe_key": r"\b[sr]k_live_[0-9A-Za-z]{16,}\b",
    "google_key": r"\bAIza[0-9A-Za-z_-]{35}",
    "jwt": r"\beyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:(?!-----BEGIN)[\s\S])*?-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?:(?:\s|\\[rn])+(?:[A-Z][\w-]*: [^\n]*|[0-9A-Za-z+/=]{16,}))+(?:(?:\s|\\[rn])+[0-9A-Za-z+/=]+(?=\s*\Z))?)",
}
#: What a text must hold, as it stands, for a format to be looked for.
STARTS = {
    "aws_key_id": ("AKIA", "ASIA"), "github_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "slack_token": ("xox",),
    "stripe_key": ("k_live_",), "google_key": ("AIza",), "jwt": ("eyJ",), "private_key": ("-----BEGIN",),
}
FORMAT = {name: re.compile(pattern) for name, pattern in FORMATS.items()}
RUN = re.compile(r"[0-9A-Za-z+/_\-]{16,}={0,2}")
QUOTED = re.compile(r"\"([^\s\"']{8,})\"|'([^\s\"']{8,})'")
NAMED = re.compile(r"(?i:(?<![A-Za-z0-9])(?:[a-z0-9]+[_-])*(?:" + "|".join(KEYWORDS) + r"))[\"']?\s{0,3}(?:=|:|=>)\s{0,3}$")
#: A value without quotes after a sign of assignment, as in .env files, shells, YAML and query strings.
BARE = re.compile(r"[^\s\"'`=:>,;&<(){}\[\]][^\s\"'`,;&<>(){}\[\]]{7,}")
SIGN = re.compile(r"(?:=>|[=:])[ \t]{0,3}")
FEATURES = "length digits upper hex symbols entropy transitions changes coverage sample keyword public quoted path format".split()
#: A missed secret costs more than a false alarm.
LEAST = 0.35
SCHEMA = "doc_id string, start long, length long, rule string, score double, is_secret boolean"


class Language:
    """The words of a tokenizer's vocabulary: how likely letters follow each other in them, and what they cover of a string."""

    def __init__(self, ranks_path: str) -> None:
        tokens = (base64.b64decode(line.split()[0]) for line in open(ranks_path, "rb") if line.strip())
        words = [t[1:].decode().lower() for t in tokens if re.fullmatch(rb" [A-Za-z]{3,12}", t)]
        self.words = {*words, *KEYWORDS, *SAMPLES}
        pairs = Counter(a + b for w in words for a, b in zip(w, w[1:], strict=False))
        firsts = Counter(a for w in words for a in w[:-1])
        letters = string.ascii_lowercase
        self.steps = {a + b: math.log((pairs[a + b] + 1) / (firsts[a] + len(letters))) for a in letters for b in letters}

    def covered(self, low: str) -> int:
        """Characters in words of four letters or more, the longest first from the left."""
        total, i, n = 0, 0, len(low)
        while i < n:
            word = next((k for k in range(min(12, n - i), 3, -1) if low[i : i + k] in self.words), 0)
            total += word
            i += word or 1
        return total


@lru_cache(maxsize=2)
def language(ranks_path: str) -> Language:
    """One for all tasks of a Python worker."""
    return Language(ranks_path)


RARE = math.log(1 / 60)


def features(value: str, before: str, after: str, path: str, rule: str, known: Language) -> list[float]:
    """The numbers the forest looks at: the candidate, the words around it and its path."""
    n, low = len(value), value.lower()
    steps = [known.steps.get(low[i : i + 2], RARE) for i in range(n - 1)]
    kind = [("d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s") for c in value]
    near, later = re.findall(r"[a-z0-9_]+", before.lower())[-4:], re.findall(r"[a-z0-9_]+", after.lower())[:4]
    has = lambda found, names: float(any(w in names or any(p in names for p in w.split("_")) for w in found))
    return [
        n, kind.count("d") / n, kind.count("u") / n, sum(c in "0123456789abcdef" for c in low) / n, kind.count("s") / n,
        -sum(k / n * math.log2(k / n) for k in Counter(value).values()), sum(steps) / max(1, len(steps)),
        sum(a != b for a, b in zip(kind, kind[1:], strict=False)) / max(1, n - 1), known.covered(low) / n,
        float(any(s in low for s in SAMPLES)), has(near, KEYWORDS), has(near, PUBLIC), has(later, PUBLIC), has(later, SAMPLES),
        float(before[-1:] in "\"'`"), float(before[-2:-1] in "[({" or before[-1:] in "[({"),
        float(any(p in re.split(r"\W+|_", path.lower()) for p in EXAMPLE_PATHS)), float(rule in FORMATS),
    ]


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, rule) of everything that may be a secret, in order and without overlaps.

    Published formats come before values assigned to a telling name, and these before long runs
    with both a digit and a letter. A run that a span of a higher rank cuts is looked at on both sides of it.
    """
    ranks: list[list[tuple[int, int, str]]] = [[], [], []]
    for name, starts in STARTS.items():
        if any(s in text for s in starts):
            ranks[0] += [(m.start(), m.end(), name) for m in FORMAT[name].finditer(text)]
    if '"' in text or "'" in text:
        for m in QUOTED.finditer(text):
            if NAMED.search(text, max(0, m.start() - 48), m.start()):
                ranks[1].append((m.start() + 1, m.end() - 1, "assigned"))
    if "=" in text or ":" in text:
        at = 0
        for m in SIGN.finditer(text):
            if m.end() >= at and NAMED.search(text, max(0, m.end() - 48), m.end()) and (value := BARE.match(text, m.end())):
                ranks[1].append((value.start(), at := value.end(), "assigned"))
    ranks[2] = [(m.start(), m.end(), "generic") for m in RUN.finditer(text)]
    out: list[tuple[int, int, str]] = []
    for spans in ranks:
        taken, i, new = out, 0, []
        for start, end, rule in sorted(spans):
            while i < len(taken) and taken[i][1] <= start:
                i += 1
            if rule != "generic":
                if (i == len(taken) or taken[i][0] >= end) and (not new or start >= new[-1][1]):
                    new.append((start, end, rule))
                continue
            k = i
            while start < end:
                stop = min(end, taken[k][0]) if k < len(taken) else end
                value = text[start:stop]
                if stop - start >= 16 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
                    new.append((start, stop, rule))
                start = taken[k][1] if stop < end else end
                k += 1
        out = sorted(taken + new)
    return out


FINDINGS = Path(__file__).with_name("findings.tsv")


def labelled_findings(known: Language, file: Path = FINDINGS, turns: int = 30, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: secret) of the findings in a file that people labelled, at most 200 rows.

    Its values stand for many alike, so each secret is taken `turns` times, with other letters and digits
    of the same kinds in the same places; its named parts, as AKIA, stay. False positives are taken as
    often, their digits changed.
    """
    r = random.Random(seed)
    x, y = [], []
    for row in file.read_text().splitlines()[1:201]:
        label, path, line = row.split("\t")
        before, rest = line.split("«", 1)
        value, after = rest.split("»", 1)
        kept = len(max((p for p in ("AKIA", "ghp_", "sk_live_", "xoxb-", "AIza", "eyJ") if value.startswith(p)), default=""))
        hexes = not re.search(r"[g-zA-Z]", value)
        for turn in range(turns):
            new = value
            if turn:
                def other(c: str) -> str:
                    if c.isdigit():
                        return r.choice(string.digits)
                    if label == "0" or not c.isalpha():
                        return c
                    return r.choice("abcdef" if hexes else string.ascii_lowercase if c.islower() else string.ascii_uppercase)

                new = value[:kept] + "".join(map(other, value[kept:]))
            found = candidates(before + new + after)
            rule = next((k for a, b, k in found if a <= len(before) < b), "generic")
            x.append(features(new, before[-60:], after[:60], path, rule, known))
            y.append(int(label))
    return np.array(x), np.array(y)


class Forest:
    """Trees on resampled rows; each split looks at a random few features and takes the lowest Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 8, seed: int = 7) -> None:
        self.random = np.random.default_rng(seed)
        self.few = max(2, int(x.shape[1] ** 0.5))
        self.trees = []
        for _ in range(trees):
            rows = self.random.integers(0, len(x), len(x))
            self.trees.append(self.grown(x[rows], y[rows], depth))
        del self.random

    def grown(self, x: np.ndarray, y: np.ndarray, depth: int):
        share = float(y.mean())
        if depth == 0 or len(y) < 6 or share in (0.0, 1.0):
            return share
        best = (share * (1 - share) * len(y) - 1e-9, None)
        for f in self.random.choice(x.shape[1], self.few, replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            cuts = np.flatnonzero(v[1:] > v[:-1])
            if not len(cuts):
                continue
            n = cuts + 1
            left, right = ones[cuts] / n, (ones[-1] - ones[cuts]) / (len(y) - n)
            cost = left * (1 - left) * n + right * (1 - right) * (len(y) - n)
            k = int(np.argmin(cost))
            if cost[k] < best[0]:
                best = (float(cost[k]), (int(f), float((v[cuts[k]] + v[cuts[k] + 1]) / 2)))
        if best[1] is None:
            return share
        f, at = best[1]
        low = x[:, f] <= at
        return f, at, self.grown(x[low], y[low], depth - 1), self.grown(x[~low], y[~low], depth - 1)

    def score(self, row: list[float]) -> float:
        total = 0.0
        for node in self.trees:
            while isinstance(node, tuple):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            total += node
        return total / len(self.trees)


def found(text: str, path: str, forest: Forest, known: Language, least: float) -> Iterator[tuple[int, int, str, float, bool]]:
    for start, end, rule in candidates(text):
        score = forest.score(features(text[start:end], text[max(0, start - 60) : start], text[end : end + 60], path, rule, known))
        yield start, end, rule, score, score >= least


def trained(ranks_path: str) -> Forest:
    return Forest(*labelled_findings(language(ranks_path)))


def path_of(docs: DataFrame) -> Column:
    """Where a document comes from: its `path`, else its `source`, else nothing."""
    names = [c for c in ("path", "source") if c in docs.columns]
    return F.coalesce(*[F.col(c).cast("string") for c in names], F.lit(""))


def scan(docs: DataFrame, ranks_path: str, least: float = LEAST) -> DataFrame:
    """A row for each candidate in the whole texts: its place in characters, its rule, the forest's score and verdict.

    The values themselves are not returned. Null and empty texts have no candidates; repeated rows
    are scanned each; an empty table gives no rows; `path`, else `source`, is the path where docs has that
    column, further columns are left aside. The vocabulary at ranks_path gives the dictionary. One pass,
    nothing is shuffled.
    """
    forest = trained(ranks_path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = language(ranks_path)
        for batch in batches:
            out = [
                (doc_id, start, end - start, rule, score, secret)
                for doc_id, text, p in zip(batch["doc_id"], batch["text"], batch["path"], strict=True)
                for start, end, rule, score, secret in found(text, p, forest, known, least)
            ]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    # ids go as strings, as pandas would round numbers beside a null
    rows = docs.where("text <> ''").select(F.col("doc_id").cast("long").cast("string"), "text", path_of(docs).alias("path"))
    return rows.mapInPandas(run, SCHEMA).withColumn("doc_id", F.col("doc_id").cast("long"))


def redact(docs: DataFrame, ranks_path: str, least: float = LEAST, mark: str = "<SECRET>") -> DataFrame:
    """docs with every secret in `text` replaced by a mark; all rows and columns stay, null texts too."""
    forest = trained(ranks_path)

    @F.pandas_udf("string")
    def clean(texts: pd.Series, paths: pd.Series) -> pd.Series:
        out, known = [], language(ranks_path)
        for text, p in zip(texts, paths, strict=True):
            parts, at = [], 0
            for start, end, _, _, secret in found(text, p, forest, known, least) if text else ():
                if secret:
                    parts += [text[at:start], mark]
                    at = end
            out.append("".join([*parts, text[at:]]) if parts else text)
        return pd.Series(out, dtype=object)

    return docs.withColumn("text", clean("text", path_of(docs)))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return scan(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))

"""Personal data by weak supervision, DataFrame functions only.

Base spans come from the strict patterns and checks of ``BASE`` and always stay. Further candidates come from the
looser patterns of ``LOOSE`` where they do not overlap a base span. Four labelers vote +1, -1 or 0 on every
candidate: the strict rule, a gazetteer (top-level domains, issuer prefixes, reserved blocks, number plans), words
in the ``CONTEXT`` characters before it, and the characters at its edges. Expectation-maximisation over the counts
of vote patterns (at most 4 * 3^4 rows on the driver) estimates each labeler's reliability and the probability of
each pattern; a logistic span classifier is then trained on these probabilities and the span's shape, and a loose
candidate with a probability of at least ``ACCEPT`` becomes a span too.

Positions are code points, end exclusive. ``split`` gives the text between matches and ``regexp_extract_all`` the
matches, so positions are running sums of their lengths. Patterns use possessive repeats and look-behinds that
change no match of the plain patterns but keep every scan linear in the text.

Defined results: null or empty text has no spans. Repeated rows are judged each. Null ids are kept. A corpus
without candidates adds nothing. Spans of different kinds may overlap; ties in start go by kind as listed. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, stored

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.5
CONTEXT = 32
CHUNK = 256
ROUNDS = 60

# fixed values: the base patterns, with possessive repeats; \G lets a match begin where the last one ended
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# a cheap test that every text with a match of the kind passes
HINT = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: ?\[at\] ?| ?\(at\) ?)[A-Za-z0-9-]{1,63}"
             r"(?:(?: ?\[dot\] ?| ?\(dot\) ?|\.)[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9-])[0-9]{4}(?:[\x20-][0-9]{4}){2}[\x20-][0-9]{1,7}(?![0-9-])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])",
}
LOOSE_HINT = {"email": r"[\[(]at[\])]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "card": r"[0-9]{4}[\x20-][0-9]{4}",
              "phone": r"[0-9]{3}[.-][0-9]{4}"}
GAZETTEER = {
    "email": (r"(?i)\.(?:com|org|net|edu|gov|io|info|biz|co|eu|de|fr|es|uk|us|ch|at|it|nl|be|ca|au|mx)$",
              r"(?i)(?:@|\(at\)|\[at\])(?:localhost|test|invalid)\b|\.(?:png|jpg|gif|js|css)$"),
    "ip": (r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.|:", r"^0*(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."),
    "card": (r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)", r"^(?:0|1[0-9]{3}\D|20[0-9]{2}\D|(\d)(?:\D?\1){9})"),
    "phone": (r"^(?:\+[1-9]|\(?[2-9][0-9]{2}\)?)", r"^\+0|^\(?[01][0-9]{2}\)?[\x20.-]"),
}
WORDS = {
    "email": (r"(?i)(?:e-?mail|mail|contact|write|reply|courriel|correo)\W*(?:\w+\W+){0,2}$", r"(?i)(?:git|ssh|scp|clone)\W*$"),
    "ip": (r"(?i)(?:\bip|address|host|server|from|client|adresse|servidor)\W*(?:\w+\W+){0,1}$",
           r"(?i)(?:version|release|section|chapter|\bv)\W*$"),
    "card": (r"(?i)(?:card|visa|credit|debit|payment|account|konto|carte|tarjeta)\W*(?:\w+\W+){0,2}$",
             r"(?i)(?:isbn|order|ref|token|serial|invoice|id)\W*(?:\w+\W+){0,1}$"),
    "phone": (r"(?i)(?:phone|tel|call|fax|mobile|cell|telefon|t.l.phone|tel.fono)\W*(?:\w+\W+){0,2}$",
              r"(?i)(?:isbn|order|ref|token|serial|invoice|id)\W*(?:\w+\W+){0,1}$"),
}
_SPAN = "array<struct<start:int,stop:int,hit:string>>"


def _found(text: Column, pattern: str, hint: str) -> Column:
    """(pieces between, matches) of a pattern; both empty where the hint already fails."""
    return F.when(text.rlike(hint), F.struct(F.split(text, pattern).alias("between"),
                                             F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")))


def _placed(found: Column) -> Column:
    """Spans (start, stop, hit) from the lengths of pieces and matches, CHUNK matches at a time."""
    n = F.size(found["hits"])

    def one(acc, i):
        start = acc["at"] + F.char_length(found["between"][i])
        stop = start + F.char_length(found["hits"][i])
        span = F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), found["hits"][i].alias("hit"))
        return F.struct(stop.cast("int").alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def chunk(acc, c):
        inner = F.aggregate(F.sequence(c, F.least(c + CHUNK, n) - 1),
                            F.struct(acc["at"].alias("at"), F.array().cast(_SPAN).alias("spans")), one)
        return F.struct(inner["at"].alias("at"), F.concat(acc["parts"], F.array(inner["spans"])).alias("parts"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("parts"))
    spans = F.aggregate(F.sequence(F.lit(0), n - 1, F.lit(CHUNK)), start, chunk, lambda acc: F.flatten(acc["parts"]))
    return F.when(n > 0, spans).otherwise(F.array().cast(_SPAN))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    values = F.transform(F.sequence(F.lit(1), F.char_length(digits)), lambda i: F.substr(back, i, F.lit(1)).cast("int"))
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
        return hit.rlike(rf"^{part}(?:\.{part}){{3}}$")
    n = F.char_length(_digits(hit))
    if kind == "card":
        return n.between(14, 19) & _luhn(_digits(hit))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda s: _valid(kind, s["hit"])


def _votes(text: Column, kind: str, s: Column, strict: bool) -> Column:
    def vote(value, yes, no):
        return F.when(value.rlike(no), -1).when(value.rlike(yes), 1).otherwise(0)

    before = F.substr(text, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT)))
    edges = F.concat(F.when(s["start"] > 0, F.substr(text, s["start"], F.lit(1))).otherwise(F.lit(" ")),
                     F.substr(text, s["stop"] + 1, F.lit(1)))
    value = _digits(s["hit"]) if kind == "card" else s["hit"]
    return F.array(F.lit(1 if strict else -1), vote(value, *GAZETTEER[kind]), vote(before, *WORDS[kind]),
                   F.when(edges.rlike(r"[\p{L}0-9_]"), -1).otherwise(1)).cast("array<int>")


def with_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``candidates``: (start, kind number, stop, base, votes, width) in order."""
    text = F.col(text_col)
    df = docs
    for k, kind in enumerate(KINDS):
        df = df.withColumn(f"_b{k}", _found(text, BASE[kind], HINT[kind])).withColumn(f"_l{k}", _found(text, LOOSE[kind], LOOSE_HINT[kind]))
    df = df.select(*docs.columns, *[F.when(F.col(f"_{x}{k}").isNotNull(), _placed(F.col(f"_{x}{k}"))).alias(f"_{x}{k}")
                                    for k in range(len(KINDS)) for x in "bl"])
    df = df.select(*docs.columns, *[F.filter(F.col(f"_b{k}"), _check(kind)).alias(f"_b{k}")
                                    for k, kind in enumerate(KINDS)], *[f"_l{k}" for k in range(len(KINDS))])
    all_base = F.concat(*[F.coalesce(F.col(f"_b{k}"), F.array().cast(_SPAN)) for k in range(len(KINDS))])
    df = df.withColumn("_base", all_base)

    def told(k, kind, spans, strict):
        return F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.lit(k).alias("kind"), s["stop"].alias("stop"), F.lit(strict).alias("base"),
            _votes(text, kind, s, strict).alias("votes"), F.least(s["stop"] - s["start"], F.lit(40)).alias("width")))

    parts = []
    for k, kind in enumerate(KINDS):
        parts.append(told(k, kind, F.col(f"_b{k}"), True))
        loose = F.filter(F.col(f"_l{k}"), lambda s: ~F.exists(
            F.col("_base"), lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
        parts.append(told(k, kind, loose, False))
    empty = F.array().cast("array<struct<start:int,kind:int,stop:int,base:boolean,votes:array<int>,width:int>>")
    found = F.array_sort(F.concat(*[F.coalesce(p, empty) for p in parts]))
    return df.withColumn("candidates", found).select(*docs.columns, "candidates")


def fit_em(cells: list[tuple[tuple, float]]) -> dict[tuple, float]:
    """Probability of each (kind, votes) pattern from weighted counts, labelers independent given the truth."""
    patterns = [p for p, _ in cells]
    weight = np.array([w for _, w in cells], float)
    kind = np.array([p[0] for p in patterns])
    votes = np.array([p[1] for p in patterns]) + 1  # 0, 1, 2
    prob = 1 / (1 + np.exp(-1.5 * (votes - 1).sum(1)))  # begins with the soft majority
    for _ in range(ROUNDS):
        score = np.zeros(len(patterns))
        for k in range(len(KINDS)):
            mine = kind == k
            if mine.any():
                prior = ((prob * weight)[mine].sum() + 1) / (weight[mine].sum() + 2)
                score[mine] += np.log(prior / (1 - prior))
        for j in range(votes.shape[1]):
            yes = np.bincount(votes[:, j], prob * weight, 3) + np.array([0.1, 0.5, 1.0])
            no = np.bincount(votes[:, j], (1 - prob) * weight, 3) + np.array([1.0, 0.5, 0.1])
            score += np.log(yes / yes.sum())[votes[:, j]] - np.log(no / no.sum())[votes[:, j]]
        prob = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return dict(zip(patterns, prob))


def fit_classifier(cells: list[tuple[tuple, float]]) -> dict[str, float]:
    """Logistic weights by feature name, trained on the probabilities of EM: kind, votes and width of a span."""
    by_votes: dict = defaultdict(float)
    for (kind, votes, _), w in cells:
        by_votes[kind, votes] += w
    prob = fit_em(list(by_votes.items()))
    names = (["bias"] + [f"kind{k}" for k in range(len(KINDS))] + [f"vote{j}" for j in range(4)]
             + [f"width{k}" for k in range(len(KINDS))])
    x = np.zeros((len(cells), len(names)))
    for row, ((kind, votes, width), _) in zip(x, cells):
        row[0] = row[1 + kind] = 1
        row[5:9] = votes
        row[9 + kind] = width / 40
    y = np.array([prob[kind, votes] for (kind, votes, _), _ in cells])
    w = np.array([w for _, w in cells], float)
    w /= w.sum()
    beta = np.zeros(len(names))
    ridge = 1e-4
    for _ in range(30):  # Newton steps on the ridge-penalised cross entropy
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) + ridge * beta
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(names))
        beta -= np.linalg.solve(hess, grad)
    return dict(zip(names, beta.tolist()))


def train(candidates: DataFrame) -> dict[str, float] | None:
    """The span classifier from rows with ``candidates`` (None without any): at most 4 * 3^4 * 40 rows collected."""
    one = candidates.select(F.explode("candidates").alias("c"))
    cells = one.groupBy("c.kind", "c.votes", "c.width").count().collect()
    if not cells:
        return None
    return fit_classifier([((r["kind"], tuple(r["votes"]), r["width"]), float(r["count"])) for r in cells])


def accepted(candidates: Column, model: dict[str, float] | None) -> Column:
    """The spans of a row: base ones and those that the classifier accepts."""
    if model is None:
        return candidates
    weights = {k: F.lit(v) for k, v in model.items()}
    by_kind = F.array(*[weights[f"kind{k}"] for k in range(len(KINDS))])
    by_width = F.array(*[weights[f"width{k}"] for k in range(len(KINDS))])

    def yes(c):
        z = weights["bias"] + F.element_at(by_kind, c["kind"] + 1) + F.element_at(by_width, c["kind"] + 1) * c["width"] / 40
        for j in range(4):
            z = z + weights[f"vote{j}"] * c["votes"][j]
        return c["base"] | (1 / (1 + F.exp(-z)) >= ACCEPT)

    return F.filter(candidates, yes)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["stop"])), ",")


def detected(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the spans (start, kind, stop, base, ...) of every row."""
    docs = columns_of(df, doc_id=id_col, text=text_col)
    rows = stored(with_candidates(docs).select("doc_id", "candidates"), "pii-candidates")
    return rows.select("doc_id", accepted(F.col("candidates"), train(rows)).alias("spans"))


def redacted(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows with every span of the text replaced by ``<KIND>`` (overlapping spans by the first one's)."""
    names = df.columns
    rows = with_candidates(df.select(*[F.col(f"`{c}`") for c in names]), text_col)
    model = train(stored(with_candidates(columns_of(df, text=text_col)).select("candidates"), "pii-candidates"))
    text = F.col(text_col)
    label = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    rows = rows.withColumn("_spans", accepted(F.col("candidates"), model))

    def cut(acc, s):
        gap = F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark = F.when(s["start"] >= acc["at"], F.element_at(label, s["kind"] + 1)).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["stop"]).cast("int").alias("at"),
                        F.concat(acc["out"], F.array(gap, mark)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(F.col("_spans"), start, cut,
                       lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1, F.char_length(text))))
    clean = F.when(F.size("_spans") > 0, done).otherwise(text)
    return rows.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in names])

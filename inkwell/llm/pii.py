"""Personal data: base patterns and boosted candidates.

Base spans come from four patterns with their checks and always stay.  Further
spans come from generators of high recall that may overlap each other; gradient
boosted trees over format and context features score each of them, the scores
are calibrated on held-out rows, and those over the threshold of their kind stay
unless they meet a base span or a better candidate.

On the corpus everything is SQL functions over arrays in the row: no shuffle, no
Python on executors.  The trees are fitted on the driver from ``TRAINING_ROWS``
labelled rows made from templates and become one SQL expression.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spans import cut, quoted, with_groups, with_matches, with_pieces

KINDS = ("email", "ip", "card", "phone", "id", "secret")
#: Labelled rows that the trees are fitted and calibrated on; the documented bound.
TRAINING_ROWS = 6000
TREES, DEPTH, RATE = 40, 3, 0.3
#: Precision that a kind's threshold reaches on the calibration rows.
PRECISION = 0.97
#: Digits of the longest number that is looked for as a whole.
MOST_DIGITS = 24
#: Characters on either side of a candidate that are looked at.
CONTEXT = 32

# Possessive forms of the base patterns.  \G or no such character before replaces
# trying each start of a run in turn, which finds the same matches in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidate generators; their spans may overlap.  ``number`` takes whole runs, those
#: of single formats propose spans inside a run.
GENERATORS = {
    "dialled": r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])",
    "token": r"(?<![0-9A-Za-z_/+-])(?=[A-Za-z_/+-]*+[0-9])(?=[0-9_/+-]*+[A-Za-z])[A-Za-z0-9_/+-]{16,80}+(?![0-9A-Za-z])",
    "number": r"(?<![0-9A-Za-z])\(?+[0-9](?:[\x20().:/-]{0,2}+[0-9])++",
    "national": r"(?<![0-9A-Za-z])\(?[0-9]{3}\)?[-.\x20]{1,2}[0-9]{3}[-.\x20][0-9]{4}(?![0-9])",
    "trunk": r"(?<![0-9A-Za-z])0[0-9]{2}[-.\x20][0-9]{4}[-.\x20][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9A-Za-z])[0-9]{3}[-\x20][0-9]{2}[-\x20][0-9]{4}(?![0-9])",
    "fours": r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20-][0-9]{4}){3}(?![0-9])",
    "coded": r"(?<![0-9A-Za-z])(?:[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?|(?:[0-9A-Fa-f]{1,4}:){5,7}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z])",
    "spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[](?:dot|DOT)[)\]]\x20?)[A-Za-z0-9-]++)++",
}


def _octet(part: str) -> str:
    return f"{part} rlike '^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$'"


def _luhn(digits: str) -> str:
    """SQL: the digits pass the Luhn check."""
    return f"aggregate(sequence(1, length({digits})), 0L, (acc, j) -> acc + CASE WHEN j % 2 = 1 THEN cast(substr({digits}, length({digits}) + 1 - j, 1) as int) ELSE (2 * cast(substr({digits}, length({digits}) + 1 - j, 1) as int)) % 10 + (2 * cast(substr({digits}, length({digits}) + 1 - j, 1) as int)) div 10 END) % 10 = 0"


CHECKS = {
    "email": "true",
    "ip": "forall(split(s.x, '[.]'), p -> " + _octet("p") + ")",
    "card": "length(regexp_replace(s.x, '[^0-9]', '')) between 16 and 19 and " + _luhn("regexp_replace(s.x, '[^0-9]', '')"),
    "phone": "length(regexp_replace(s.x, '[^0-9]', '')) between 8 and 15",
}
#: A text that fails its test has no match of the kind; it spares the pattern.
TESTS = {"email": "instr(text, '@') > 0", "ip": "digits", "card": "digits", "phone": "digits and instr(text, '+') > 0", "number": "digits", "national": "digits", "trunk": "digits", "ssn": "digits", "fours": "digits", "coded": "digits", "dialled": "digits and instr(text, '+') > 0", "token": "digits", "spelled": "text rlike '[(\\\\[](?:at|AT)[)\\\\]]'"}

#: Patterns that few texts match: those without a match are not split, which spares memory.
RARE = {"dialled", "token", "national", "trunk", "ssn", "fours", "coded"}


def _matches(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Adds for each pattern an array of structs (a, b, x): start and end in code
    points and the matched text."""
    for name, pattern in names.items():
        test = f"{TESTS[name]} and text rlike {quoted(pattern)}" if name in RARE else TESTS[name]
        df = with_matches(df, name, pattern, test)
    return df


#: Small whole numbers over a candidate c with x (text), l and r (context).
FEATURES = {
    "digits": "least(length(regexp_replace(c.x, '[^0-9]', '')), 24)",
    "size": "least(length(c.x), 48)",
    "groups": "least(size(split(c.x, '[^0-9]+')), 12)",
    "dashes": "least(regexp_count(c.x, '-'), 6)",
    "dots": "least(regexp_count(c.x, '[.]'), 6)",
    "blanks": "least(regexp_count(c.x, ' '), 6)",
    "colons": "least(regexp_count(c.x, '[:/]'), 8)",
    "paren": "cast(c.x rlike '^[(]?[0-9]{2,4}[)]' as int)",
    "letters": "least(length(regexp_replace(c.x, '[^A-Za-z]', '')), 12)",
    "at": "cast(c.x rlike '(?i)[(\\\\[]at[)\\\\]]' as int)",
    "ssn": "cast(c.x rlike '^[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}$' as int)",
    "national": "cast(c.x rlike '^[(]?[0-9]{3}[)]?[-. ]{1,2}[0-9]{3}[-. ][0-9]{4}$' as int)",
    "date": "cast(c.x rlike '^([0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4})' as int)",
    "clock": "cast(c.x rlike '[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?$' as int)",
    "fours": "cast(c.x rlike '^[0-9]{4}([ -][0-9]{4}){3}' as int)",
    "call": "cast(c.l rlike '(?i)(call|tel|phone|fax|mobile|cell|whatsapp|sms|dial)' as int)",
    "identity": "cast(c.l rlike '(?i)(ssn|social|passport|iban|account|tax|mac|licen[sc]e n)' as int)",
    "pay": "cast(c.l rlike '(?i)(card|visa|master|credit|debit|pay)' as int)",
    "mail": "cast(c.l rlike '(?i)(mail|contact|write|reach)' as int)",
    "thing": "cast(c.l rlike '(?i)(order|invoice|version|page|isbn|issn|build|serial|part|sku|ticket|no[.]|doi|lot)' as int)",
    "money": "cast(c.l rlike '[$€£¥#v]\\\\s?$' as int)",
    "plus": "cast(c.x rlike '^[+]' as int)",
    "upper": "least(length(regexp_replace(c.x, '[^A-Z]', '')), 24)",
    "hex": "cast(c.x rlike '^([0-9a-f]{16,}|[0-9A-F]{16,})$' as int)",
    "access": "cast(c.x rlike '^(AKIA|ASIA|ghp_|gho_|sk-|sk_|xox|glpat-)' as int)",
    "assigned": "cast(c.l rlike '(?i)(password|passwd|pwd|secret|token|api.?key|access.?key|auth|bearer)[^A-Za-z0-9]{0,6}$' as int)",
    "unit": "cast(c.r rlike '^ ?([%€]|km|kg|usd|eur|pages|items|people|years|ms|mb|gb)' as int)",
}
FEATURE_NAMES = list(FEATURES)
KIND_OF = "CASE WHEN c.x rlike '(?i)[(\\\\[]at[)\\\\]]' THEN 'email' WHEN c.x rlike '^[A-Za-z0-9_/+-]{16,}$' AND c.x rlike '[A-Za-z]' AND NOT c.x rlike '^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$' THEN 'secret' WHEN c.x rlike '[A-Za-z]' OR regexp_count(c.x, ':') >= 5 OR c.x rlike '^[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}$' THEN 'id' WHEN length(regexp_replace(c.x, '[^0-9]', '')) >= 13 THEN 'card' ELSE 'phone' END"


def training_rows(n: int = TRAINING_ROWS, seed: int = 7) -> list[tuple[str, str, str, int]]:
    """(left, candidate, right, personal) from templates, half of them personal."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8)))
    sep = lambda: r.choice("-. ")
    calls = ["call ", "tel: ", "phone ", "mobile ", "fax ", "call me at ", "reach me on my cell "]
    personal = [
        lambda: (r.choice(calls), (s := sep()) and f"{d(3)}{s}{d(3)}{s}{d(4)}"),
        lambda: (r.choice([*calls, w() + " "]), f"({d(3)}) {d(3)}-{d(4)}"),
        lambda: (r.choice([*calls, "line ", "desk ", w() + " "]), f"0{d(2)}" + 2 * (r.choice(" -.") + d(4))),
        lambda: (w() + " ", (s := r.choice("-.")) and f"{d(3)}{s}{d(3)}{s}{d(4)}"),
        lambda: (f"{d(3)}-{d(3)}-{d(4)} ", (s := sep()) and f"{d(3)}{s}{d(3)}{s}{d(4)}"),
        lambda: (r.choice(["ssn ", "social security ", "my ssn is ", w() + " "]), f"{d(3)}-{d(2)}-{d(4)}"),
        lambda: (r.choice(["card ", "visa ", "pay with ", "credit card ", "card no "]), r.choice(" -").join(d(4) for _ in range(4))),
        lambda: (r.choice(["iban ", "account ", w() + " "]), r.choice(["DE", "FR", "ES"]) + d(2) + "".join(" " + d(4) for _ in range(r.randint(3, 6)))),
        lambda: (r.choice(["mac ", "device ", w() + " "]), ":".join(r.choice("0123456789abcdef") + r.choice("0123456789abcdef") for _ in range(6))),
        lambda: (r.choice(["mail ", "write to ", "contact ", w() + " "]), f"{w()}.{w()} (at) {w()} (dot) com"),
        lambda: (r.choice(["mail ", "contact "]), f"{w()}[at]{w()}.org"),
    ]
    hexed = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))
    personal += [
        lambda: (w() + " ", f"+{r.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}"),
        lambda: (r.choice(["password=", "passwd: ", "pwd=", 'token = "', "secret: ", "api_key="]), "a1" + hexed(r.randint(14, 40))),
        lambda: (r.choice(["token=", 'auth_token: "', "access key ", "api key: "]), "x9" + mixed(r.randint(18, 40))),
        lambda: (w() + " ", "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(15)) + "7"),
        lambda: (w() + " ", "ghp_" + "b4" + mixed(34)),
    ]
    other = [
        lambda: (r.choice(["commit ", "sha1 ", "build ", w() + " "]), "a1" + hexed(r.choice([18, 30, 38]))),
        lambda: (r.choice(["page ", w() + " "]), f"{w()}-{w()}-{w()}-{d(2)}-{w()}-{w()}"),
        lambda: (w() + " ", f"{w()}/{w()}/{w()}/{d(4)}/{w()}"),
        lambda: (r.choice(["on ", "since ", w() + " "]), f"20{d(2)}-{d(2)}-{d(2)}"),
        lambda: (r.choice(["on ", "until "]), f"{d(2)}/{d(2)}/{d(4)} {d(2)}:{d(2)}"),
        lambda: (r.choice(["order ", "invoice no. ", "ticket ", "serial "]), d(r.randint(7, 16))),
        lambda: (r.choice(["isbn ", "issn "]), f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}"),
        lambda: (r.choice(["version ", "build ", "v"]), ".".join(d(r.randint(1, 3)) for _ in range(4))),
        lambda: (r.choice(["$", "€ ", "cost "]), f"{d(2)}.{d(3)}.{d(3)}"),
        lambda: (w() + " ", d(r.randint(7, 12))),
        lambda: (w() + " ", f"{d(3)} {d(3)} {d(3)}"),
        lambda: (r.choice(["pages ", "lot ", w() + " "]), f"{d(4)}-{d(4)}"),
        lambda: (w() + " ", " ".join(d(r.randint(1, 3)) for _ in range(r.randint(4, 9)))),
        lambda: ("part ", f"{d(3)}-{d(3)}-{d(4)}"),
    ]
    tails = ["", " ", ". ", " and ", ", "]
    rows = []
    for i in range(n):
        left, x = r.choice(personal if i % 2 else other)()
        right = r.choice([*tails, " km", " items", "%"]) if i % 2 == 0 else r.choice(tails)
        rows.append((f"{w()} {w()} {left}"[-CONTEXT:], x, (right + w())[:CONTEXT], i % 2))
    return rows


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[tuple]:
    """Trees ((feature, cut, left, right) or a leaf value) of logistic boosting."""
    trees, raw = [], np.zeros(len(y))

    def grow(rows: np.ndarray, depth: int):
        g, h = (weight * (y - p))[rows], (weight * p * (1 - p))[rows]
        best = (1e-6, None, None)
        if depth:
            whole = g.sum() ** 2 / (h.sum() + 1)
            for f in range(x.shape[1]):
                values = x[rows, f]
                for cut in np.unique(values)[:-1]:
                    low = values <= cut
                    gl, hl = g[low].sum(), h[low].sum()
                    gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - whole
                    if gain > best[0] + 1e-12:
                        best = (gain, f, int(cut))
        if best[1] is None:
            return float(RATE * g.sum() / (h.sum() + 1))
        low = x[rows, best[1]] <= best[2]
        return best[1], best[2], grow(rows[low], depth - 1), grow(rows[~low], depth - 1)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        tree = grow(np.arange(len(y)), DEPTH)
        trees.append(tree)
        raw = raw + evaluate(tree, x)
    return trees


def evaluate(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, left, right = tree
    return np.where(x[:, f] <= cut, evaluate(left, x), evaluate(right, x))


def tree_sql(tree) -> str:
    if not isinstance(tree, tuple):
        return f"{tree:.6f}D"
    f, cut, left, right = tree
    return f"CASE WHEN v.{FEATURE_NAMES[f]} <= {cut} THEN {tree_sql(left)} ELSE {tree_sql(right)} END"


def _with_features(array: str) -> str:
    inner = ", ".join(f"{sql} as {name}" for name, sql in FEATURES.items())
    return f"transform({array}, c -> struct(c.a as a, c.b as b, {KIND_OF} as kind, {inner}))"


_fitted: dict[tuple, tuple[str, dict[str, float]]] = {}


def fit(spark: SparkSession, rows: int = TRAINING_ROWS) -> tuple[str, dict[str, float]]:
    """(SQL for the calibrated score of struct v, threshold of each kind)."""
    if rows in _fitted:
        return _fitted[rows]
    made = spark.createDataFrame([(i % 4 == 3 or i % 4 == 2 and i % 8 > 3, *r) for i, r in enumerate(training_rows(rows))], "held boolean, l string, x string, r string, y int")
    vectors = made.select("held", "y", F.expr(_with_features("array(struct(0L as a, 0L as b, l, x, r))") + "[0]").alias("v"))
    # equal vectors are counted; there are at most as many as labelled rows
    counted = vectors.groupBy("held", "y", "v.kind", *[f"v.{n}" for n in FEATURE_NAMES]).count().collect()
    x = np.array([[r[n] for n in FEATURE_NAMES] for r in counted], dtype=np.int64)
    y, n = np.array([r["y"] for r in counted]), np.array([r["count"] for r in counted], dtype=float)
    held, kinds = np.array([r["held"] for r in counted]), np.array([r["kind"] for r in counted])
    order = np.lexsort((*x.T, y, held))
    x, y, n, held, kinds = x[order], y[order], n[order], held[order], kinds[order]
    trees = boost(x[~held], y[~held], n[~held])
    raw = sum(evaluate(t, x) for t in trees)
    slope, shift = 1.0, 0.0
    for _ in range(200):  # Platt scaling on the held-out rows
        p = 1 / (1 + np.exp(-(slope * raw[held] + shift)))
        e = n[held] * (y[held] - p)
        slope, shift = slope + 0.5 * (e * raw[held]).sum() / (n[held] * (1 + raw[held] ** 2)).sum(), shift + 0.5 * e.sum() / n[held].sum()
    p = 1 / (1 + np.exp(-(slope * raw + shift)))
    limits = {}
    for kind in KINDS:
        own = held & (kinds == kind)
        cuts = [c for c in np.unique(p[own]) if (n * y)[own & (p >= c)].sum() >= PRECISION * n[own & (p >= c)].sum()]
        limits[kind] = max(0.5, float(min(cuts))) if cuts else 1.1
    total = " + ".join(tree_sql(t) for t in trees)
    _fitted[rows] = f"1 / (1 + exp(-({slope:.6f}D * ({total}) + ({shift:.6f}D))))", limits
    return _fitted[rows]


def _spans(df: DataFrame, training: int) -> DataFrame:
    """Adds arrays of (a, b, kind): ``__base`` by kind and ``__all`` with what the
    trees add, both by kind and start.  ``df`` has a column text without nulls."""
    score, limits = fit(df.sparkSession, training)
    df = df.withColumn("digits", F.expr("text rlike '[0-9]'"))
    df = _matches(df, BASE)
    df = df.withColumns({k: F.expr(f"transform(filter({k}, s -> {CHECKS[k]}), s -> struct(s.a as a, s.b as b, '{k}' as kind))") for k in BASE})
    df = df.withColumn("__base", F.concat(*[F.col(k) for k in BASE]))
    df = _matches(df, GENERATORS)
    # a base span has no x; what another generator proposed too, or a base span meets, goes
    # a run of more digits than any number has is left to the generators of single formats
    usable = f"length(regexp_replace(c.x, '[^0-9]', '')) between 7 and {MOST_DIGITS} or c.x rlike '[A-Za-z]'"
    proposed = f"filter(concat({', '.join(GENERATORS)}), c -> {usable})"
    df = df.withColumn("__c", F.expr(f"CASE WHEN digits or {' or '.join(f'size({g}) > 0' for g in GENERATORS)} THEN {proposed} ELSE array() END"))
    df = df.withColumn("__c", F.expr("CASE WHEN size(__c) > 0 THEN concat(__c, transform(__base, o -> struct(o.a as a, o.b as b, cast(null as string) as x))) ELSE __c END"))
    df = with_groups(df, "__c", "__c")
    df = df.withColumn("__c", F.expr("flatten(transform(__c, g -> filter(g, (c, i) -> c.x is not null and (i = 0 or g[i - 1] <> c) and not exists(g, o -> o.x is null and o.a < c.b and c.a < o.b))))"))
    df = with_pieces(df, "__w", "size(__c) > 0")
    left, right = cut("__w", f"greatest(c.a - {CONTEXT}, 0L)", "c.a"), cut("__w", "c.b", f"c.b + {CONTEXT}")
    df = df.withColumn("__c", F.expr(f"transform(__c, c -> struct(c.a as a, c.b as b, c.x as x, {left} as l, {right} as r))"))
    df = df.withColumn("__c", F.expr(_with_features("__c")))
    df = df.withColumn("__c", F.expr(f"transform(__c, v -> struct(v.a as a, v.b as b, {score} as p, v.kind as kind))"))
    over = " or ".join(f"(c.kind = '{k}' and c.p >= {limits[k]:.6f}D)" for k in KINDS)
    df = with_groups(df, f"filter(__c, c -> {over})", "__c")
    # an id keeps its groups together; else the better score, then the longer one
    whole = "{0}.kind = 'id' and {1}.kind in ('card', 'phone') and {0}.a <= {1}.a and {0}.b >= {1}.b"
    better = "(o.p > c.p or (o.p = c.p and (o.b - o.a > c.b - c.a or (o.b - o.a = c.b - c.a and o.a < c.a))))"
    df = df.withColumn("__c", F.expr(f"flatten(transform(__c, g -> filter(g, c -> not exists(g, o -> o.a < c.b and c.a < o.b and (({whole.format('o', 'c')}) or ({better} and not ({whole.format('c', 'o')})))))))"))
    added = [F.expr(f"transform(filter(__c, c -> c.kind = '{k}'), c -> struct(c.a as a, c.b as b, c.kind as kind))") for k in KINDS]
    every = [F.array_sort(F.concat(F.col(k), a)) if k in BASE else F.array_sort(a) for k, a in zip(KINDS, added)]
    return df.withColumn("__all", F.concat(*every))


def _written(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', cast(s.a as string), ':', cast(s.b as string))), ',')")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", training: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added).

    The counts and the digest are those of base spans.  Null and empty texts have
    no spans.  Equal starts cannot arise within a kind; repeated rows give repeated
    rows; an empty table gives none; ids may be null; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = _spans(rows, training)
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_written("__base"), 256).alias("base_sha256"),
        _written("__all").alias("spans"),
        (F.size("__all") - F.size("__base")).cast("long").alias("n_added"),
    )


def redact(docs: DataFrame, text_col: str = "text", training: int = TRAINING_ROWS) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; spans that meet
    are replaced as one, by the first one's kind.

    All rows and columns stay, repeated ones too; a null text stays null and an
    empty one empty; an empty table gives an empty one; columns may have any names.
    """
    own = docs.columns
    rows = docs.select(F.struct(*[F.col(c) for c in own]).alias("__row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = with_groups(_spans(rows, training), "__all", "__q")
    found = found.withColumn("__q", F.expr("transform(__q, g -> struct(g[0].a as a, array_max(transform(g, s -> s.b)) as b, g[0].kind as kind))"))
    found = with_pieces(found.drop("__w"), "__w", "size(__q) > 0")
    between = cut("__w", "if(i = 0, 0L, __q[i - 1].b)", "h.a")
    rest = cut("__w", "__q[size(__q) - 1].b", "cast(length(text) as bigint)")
    text = F.expr(f"concat(array_join(transform(__q, (h, i) -> concat({between}, '[', upper(h.kind), ']')), ''), {rest})")
    clean = F.when(F.size("__q") > 0, text).otherwise(F.col("text"))
    return found.select(*[F.when(F.col(f"__row.`{c}`").isNotNull(), clean).alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in own])

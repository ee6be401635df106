"""Secret scans with a random forest against false positives, in DataFrame functions only.

A regular expression finds candidates: long runs of key characters with a letter and a digit, and shorter values that
are assigned to a name like password or token. A random forest then looks at each: length, transitions between kinds of
characters, how much of it dictionary words cover, whether it lies in a path, and the neighbouring words. It was trained
on labelled findings; candidates it calls secrets are findings.

The forest is trained by Spark ML on ``TRAINING_ROWS`` labelled findings that ``labelled_findings`` generates (there
are no labelled findings among the tables), in one partition and with a seed, so that every run has the same forest. It
is applied as an expression over the candidates of a row, in the row: nothing is exploded, joined or shuffled, and a
text with many candidates is only a longer row: candidates are looked at in the stretches of text that the scan yields.

Defined results: null text has no candidates and stays null; starts and ends count code points, ends are exclusive;
repeated rows and null ids are rows like any others; texts are read whole; an empty table gives an empty result; input
columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.shared import let, running_sums

TRAINING_ROWS = 6_000
TREES, DEPTH, SEED = 24, 8, 11
MASK = "<SECRET>"
#: Characters before and after a candidate that count as its surroundings, and the least that a candidate has.
AROUND, AFTER, SHORTEST = 40, 8, 8

CUE = "password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|bearer"
CANDIDATE = (
    r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}={0,2}"
    rf"|(?<=[=:\"']|[=:]\x20)(?<=(?i:{CUE.replace('?', '{0,1}')})[\"']{{0,1}}\x20{{0,1}}[=:]\x20{{0,1}}[\"']{{0,1}})[^\s\"'<>,;]{{8,}}"
)
SCAN = rf"\G[\s\S]*?({CANDIDATE})"

#: Words that names, paths and placeholders are made of.
DICTIONARY = (
    "about access account admin advert alpha android apache apple archive article asset author backup beta bin blog book build cache card change chapter "
    "class client cloud code common config content core count create current customer data date default delete demo design dist document download edition "
    "email entry error event example factory file first folder form format free from function game get global group guide handler have help here home host "
    "html http image index info insert install item java json key last learn lib linux list local login logo mail main make manager media message method "
    "mobile model module month music name network news next node note number object open option order package page param part pass password path phone photo "
    "php place player plugin point post product profile project public python query read refresh release report request result review root sample script search "
    "secret section select series server service session set share shop site size sort source src start state status store string style submit system table tag "
    "team temp template test text the theme this time title token top type update upload url user usr util value var version video view web week widget window "
    "with word work world year your"
).split()

FEATURES = ["length", "kinds", "turns", "digits", "capitals", "hexadecimal", "distinct", "words", "separators", "path", "cue", "assigned", "decoy", "known", "uuid"]


def features(value: Column, before: Column, after: Column) -> dict[str, Column]:
    n = F.length(value)
    low, lead = F.lower(value), F.lower(before)

    def share(pattern: str, of: Column = value) -> Column:
        return (n - F.length(F.regexp_replace(of, pattern, ""))) / n

    def says(of: Column, pattern: str) -> Column:
        return F.when(F.regexp_like(of, F.lit(pattern)), 1.0).otherwise(0.0)

    return {
        "length": n.cast("double"),
        "kinds": F.regexp_count(value, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+")) / n,
        "turns": F.regexp_count(low, F.lit("[aeiou]+|[^aeiou]+")) / n,
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "hexadecimal": says(value, "^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "words": share("(?:" + "|".join(sorted((w for w in DICTIONARY if len(w) >= 3), key=lambda w: (-len(w), w))) + ")", low),
        "separators": share("[-_/.+]"),
        "path": says(F.concat(F.substring(before, -1, 1), F.lit("\t"), value, F.lit("\t"), after), r"^[./\\~]|\t[^\t]*/[^\t]*/|\t\.[a-z]{2,4}\b|\t/"),
        "cue": says(lead, rf"(?:{CUE})[^a-z]{{0,6}}$"),
        "assigned": says(before, "[=:] ?[\"']?$"),
        "decoy": says(lead, r"(?:commit|sha-?[0-9]*|md5|checksum|digest|hash|uuid|guid|revision|rev|build|version|isbn|order|invoice|serial|base64,?|integrity|etag|id)[^a-z]{0,6}$"),
        "known": says(value, "^(?:AKIA|ASIA)[A-Z0-9]{16}$|^(?:gh[pousr]_|sk_live_|rk_live_|xox[abprs]-|AIza|eyJ|glpat-)"),
        "uuid": says(low, "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
    }


def labelled_findings(spark: SparkSession, rows: int = TRAINING_ROWS, seed: int = SEED) -> DataFrame:
    """(value, before, after, label): keys of known make and assigned random values against digests, ids, paths, names.

    Everything is derived from SHA-512 of the row number, so the set is the same on every cluster.
    """
    words = f"split('{' '.join(DICTIONARY)}', ' ')"
    word = lambda k: f"element_at({words}, 1 + cast(conv(substr(h, {k}, 6), 16, 10) AS int) % {len(DICTIONARY)})"
    n = lambda k, m: f"cast(conv(substr(h, {k}, 6), 16, 10) AS int) % {m}"
    plain = "regexp_replace(base64(unhex(h)), '[^A-Za-z0-9]', '')"
    prose = f"concat({word(60)}, ' ', {word(66)}, ' ')"
    quote = f"element_at(array('=', ' = \"', ': ', '=\"', ': \"'), 1 + {n(72, 5)})"
    cue = f"element_at(array('password', 'token', 'secret', 'api_key', 'PASSWORD', 'Token', 'access_key', 'auth', 'passwd'), 1 + {n(78, 9)})"
    decoy = f"element_at(array('commit ', 'sha256:', 'md5 ', 'checksum ', 'revision ', 'etag: ', 'integrity=', 'build ', 'digest: ', 'hash '), 1 + {n(78, 10)})"
    slug = lambda s: f"concat_ws('{s}', {word(1)}, {word(7)}, {word(13)}, {word(19)}, cast({n(25, 3000)} AS string))"
    secret = [
        (f"concat('AKIA', substr(upper({plain}), 1, 16))", prose),
        (f"concat('AKIA', substr(upper({plain}), 1, 16))", f"concat({cue}, {quote})"),
        ("substr(h, 1, 40)", f"concat({prose}, {cue}, {quote})"),
        (f"substr(h, 1, 12 + {n(90, 40)})", f"concat({prose}, {cue}, {quote})"),
        (f"substr({plain}, 1, 10 + {n(90, 40)})", f"concat({prose}, {cue}, {quote})"),
        (f"substr(base64(unhex(h)), 1, 40 + {n(90, 30)})", f"concat({prose}, {cue}, {quote})"),
        (f"concat(element_at(array('ghp_', 'sk_live_', 'xoxb-', 'glpat-', 'AIza'), 1 + {n(90, 5)}), substr({plain}, 1, 36))", prose),
        (f"concat('eyJ', substr({plain}, 1, 60))", "'Authorization: Bearer '"),
        (f"substr({plain}, 1, 24 + {n(90, 20)})", prose),
    ]
    harmless = [
        (f"substr(h, 1, 8 * (2 + {n(90, 7)}))", f"concat({prose}, {decoy})"),
        ("concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12))", f"concat({prose}, element_at(array('id=', 'uuid ', 'guid: ', ' '), 1 + {n(78, 4)}))"),
        (slug("/"), f"element_at(array('/', './', '~/', ' ', 'http://'), 1 + {n(78, 5)})"),
        (slug("-"), prose),
        (slug("_"), f"element_at(array({prose}, concat({cue}, {quote})), 1 + {n(78, 2)})"),
        (f"concat({word(1)}, initcap({word(7)}), initcap({word(13)}), initcap({word(19)}), cast({n(25, 99)} AS string))", f"element_at(array({prose}, concat({cue}, {quote})), 1 + {n(84, 2)})"),
        (f"concat(element_at(array('changeme', 'your_password_', 'xxxxxxxxxxxx', 'YOUR_API_KEY_', 'example_token_', '0000000a0000'), 1 + {n(84, 6)}), cast({n(25, 99)} AS string))", f"concat({cue}, {quote})"),
        ("substr(base64(unhex(h)), 1, 60)", "'url(data:image/png;base64,'"),
        (f"concat_ws('-', substr(upper({plain}), 1, 2), '2024', lpad(cast({n(25, 99999)} AS string), 6, '0'), substr(upper({plain}), 3, 4))", f"concat({prose}, element_at(array('serial ', 'order ', 'invoice '), 1 + {n(78, 3)}))"),
    ]
    kinds = [(v, b, 1.0) for v, b in secret] + [(v, b, 0.0) for v, b in harmless]
    pick = lambda k: "CASE kind " + " ".join(f"WHEN {i} THEN {row[k]}" for i, row in enumerate(kinds)) + " END"
    numbered = spark.range(0, rows, 1, 1).selectExpr(f"cast(id % {len(kinds)} AS int) AS kind", f"sha2(concat('{seed}:', cast(id AS string)), 512) AS h")
    return numbered.selectExpr(f"{pick(0)} AS value", f"{pick(1)} AS before", f"element_at(array(' ', '\"', '.', '\" {DICTIONARY[0]}'), 1 + {n(100, 4)}) AS after", f"CASE WHEN kind < {len(secret)} THEN 1.0D ELSE 0.0D END AS label")


def train_forest(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
    """A Spark ML random forest over (value, before, after, label) rows; one partition, so that runs agree."""
    made = features(F.col("value"), F.col("before"), F.col("after"))
    rows = findings.select("label", *[made[name].alias(name) for name in FEATURES]).coalesce(1)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("label", "features")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=32, minInstancesPerNode=5).fit(rows)


_fitted: dict[str, str] = {}


def default_forest(spark: SparkSession) -> str:
    """The forest of the generated findings as SQL, fitted once per application: it depends on nothing else."""
    key = spark.sparkContext.applicationId
    if key not in _fitted:
        _fitted.clear()
        _fitted[key] = as_sql(train_forest(labelled_findings(spark)), "c.of.")
    return _fitted[key]


def as_sql(model, of: str = "") -> str:
    """The forest's probability of a secret, as nested conditions over the features; ``of`` is put before their names."""

    def walk(node) -> str:
        if node.subtreeDepth() == 0:
            harmless, secret = node.impurityStats().stats()
            return f"{secret / (harmless + secret)!r}D"
        split = node.split()
        return f"IF({of}{FEATURES[split.featureIndex()]} <= {split.threshold()!r}D, {walk(node.leftChild())}, {walk(node.rightChild())})"

    trees = [walk(tree._java_obj.rootNode()) for tree in model.trees]
    return f"({' + '.join(trees)}) / {len(trees)}"


def in_context(whole: Column, value: Column, ends: Column, rest: Column) -> Column:
    """Each candidate's place, the text since the one before it (gap), and its surroundings on either side.

    ``whole`` are the stretches of text that end in a candidate. A candidate has ``SHORTEST`` characters or more, so its
    surroundings lie in the few stretches beside it: the text is not looked at again.
    """
    back = -(-AROUND // SHORTEST)

    def around(tails: Column) -> Column:
        def one(v: Column, i: Column) -> Column:
            stretch, end, n = F.element_at(whole, i + 1), F.element_at(ends, i + 1), F.length(v)

            def with_gap(gap: Column) -> Column:
                earlier = [F.coalesce(F.when(i >= k, F.element_at(tails, F.greatest(i - k, F.lit(0)) + 1)), F.lit("")) for k in range(back, 0, -1)]
                before = let(F.concat(*earlier, gap), lambda x: F.right(x, F.lit(AROUND)))
                after = F.when(i + 1 < F.size(whole), F.left(F.element_at(whole, F.least(i + 2, F.size(whole))), F.lit(AFTER))).otherwise(F.left(rest, F.lit(AFTER)))
                return F.struct((end - n).alias("start"), end.alias("end"), v.alias("value"), gap.alias("gap"), before.alias("before"), after.alias("after"))

            return let(F.left(stretch, F.length(stretch) - n), with_gap)

        return F.transform(value, one)

    return let(F.transform(whole, lambda x: F.right(x, F.lit(AROUND))), around)


def scan_secrets(docs: DataFrame, *, text_col: str = "text", keep: Sequence[str] | None = None, model=None, threshold: float = 0.5) -> DataFrame:
    """The ``keep`` columns (all by default), candidates (start, end, score, secret) and redacted, the text without its secrets."""
    made = ["candidates", "redacted"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]
    forest = default_forest(docs.sparkSession) if model is None else as_sql(model, "c.of.")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("whole", F.coalesce(F.regexp_extract_all("text", F.lit(SCAN), F.lit(0)), F.array().cast("array<string>")))
    rows = rows.withColumn("value", F.when(F.size("whole") > 0, F.regexp_extract_all("text", F.lit(SCAN), F.lit(1))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("ends", running_sums(F.transform("whole", F.length)))
    rows = rows.withColumn("rest", F.substring("text", F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)) + 1, F.length("text")))


    def with_facts(c: Column) -> Column:
        of = features(c["value"], c["before"], c["after"])
        return F.struct(*[c[name].alias(name) for name in ("start", "end", "value", "gap")], F.struct(*[of[name].alias(name) for name in FEATURES]).alias("of"))

    rows = rows.withColumn("found", F.transform(in_context(F.col("whole"), F.col("value"), F.col("ends"), F.col("rest")), with_facts))
    rows = rows.withColumn("found", F.expr(f"transform(found, c -> struct(c.start, c.end, c.value, c.gap, {forest} AS score))"))
    secret = lambda c: c["score"] >= threshold
    pieces = F.transform("found", lambda c: F.concat(c["gap"], F.when(secret(c), F.lit(MASK)).otherwise(c["value"])))
    redacted = F.when(F.exists("found", secret), F.concat(F.array_join(pieces, ""), F.col("rest"))).otherwise(F.col("text"))
    candidates = F.transform("found", lambda c: F.struct(c["start"].cast("long").alias("start"), c["end"].cast("long").alias("end"), c["score"].alias("score"), secret(c).alias("secret")))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in kept], candidates.alias("candidates"), redacted.alias("redacted"))

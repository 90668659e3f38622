"""Personal data: fixed patterns, and bootstrapped contextual extraction of unseen identifiers.

The fixed patterns of all base kinds give seed entities. What stands before
them and before identifier-like tokens in the texts are lexical patterns.
Patterns and the tokens after them form a graph that is scored round by round:
a pattern is as good as the tokens after it, and a token as good as the
patterns before it. Tokens accepted in one round are seeds in the next, so that
they induce further patterns, until nothing is added. After patterns of high
confidence, tokens of any other shape are taken as identifiers too. All of it
is DataFrame operations, and takes time in proportion to a text's length and
matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm._common import stored, without

#: The base kinds in their order, and their patterns. The quantifiers are possessive and starts inside of a run are ruled
#: out where that can't change a match, so that long runs cost linear time and no stack.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that every match has, to pass over texts without.
NEEDS = {"email": "@", "phone": "+", "ip": "."}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP_FITS = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"
#: Further seeds: strings of 32 or more hexadecimal digits, as keys and tokens are.
SECRET = "secret"
SECRET_SEED = r"^(?=[^0-9]*[0-9])(?=[^A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{32,}$"
#: Identifier-like tokens: six or more characters with a digit.
TOKEN = r"(?<![A-Za-z0-9_+/@.-])(?=[A-Za-z_+/@.-]*+[0-9])[A-Za-z0-9_+/@.-]{6,}+"
#: What stands before a token: a word, and marks that announce a value. At most so many characters are looked at.
BEFORE, BEFORE_CHARS = r"([\p{L}_]{2,24}+)([\x20\t]{0,2}[=:#]{1,2}[\x20\t]{0,2}[\"']?)$", 40
#: Rounds of bootstrapping, at most; they end when a round adds nothing.
ROUNDS = 6
#: Patterns and tokens that are accepted: distinct seeds after a pattern, and confidence.
LEAST_TOKENS, CONFIDENT = 3, 0.8
#: The weight of doubt about a pattern, in tokens.
DOUBT = 0.5
#: Up to so many texts with learned patterns are sent to all tasks; more are joined by their digest.
MAX_BROADCAST = 200_000
#: Elements of an array that are worked through one by one; longer arrays are cut into chunks.
CHUNK = 64


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chunks(values: Column) -> Column:
    """Consecutive parts of an array that isn't empty, about as many as each has elements."""

    def of(size: Column) -> Column:
        last = F.floor((F.size(values) - 1) / size).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(values, c * size + 1, size))

    return _let(F.greatest(F.lit(CHUNK), F.ceil(F.sqrt(F.size(values)))).cast("int"), of)


def _running(values: Column, step) -> Column:
    """For each whole number in an array, what ``step`` (a sum or maximum from 0) makes of those before it.

    Long arrays are cut into chunks, whose totals are run through first, so
    that the work grows with the 3/2 power of the length, by copying numbers
    only. ``values`` is used several times, so it should be bound by ``_let``.
    """

    def one_by_one(some: Column, begin: Column) -> Column:
        empty = F.struct(begin.alias("at"), F.array().cast("array<int>").alias("out"))
        add = lambda s, v: F.struct(step(s["at"], v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(some, empty, add, lambda s: s["out"])

    def in_chunks(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), step))
        return F.flatten(F.zip_with(chunks, one_by_one(totals, F.lit(0)), one_by_one))

    return F.when(F.size(values) <= CHUNK, one_by_one(values, F.lit(0))).otherwise(_let(_chunks(values), in_chunks))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _largest(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _found(text: Column, pattern: str, needs: str | None) -> Column:
    """The matches, in order; texts without the character ``needs`` are passed over."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.contains(text, F.lit(needs)), found).otherwise(F.array().cast("array<string>")) if needs else found


def _placed(found: Column, gaps: Column) -> Column:
    """Of matches and the texts between them: structs (start, stop, value, before)."""
    empty = F.array().cast("array<struct<start:int,stop:int,value:string,before:string>>")
    lengths = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda v, g: F.length(v) + F.length(g))

    def spans(begins: Column) -> Column:
        def one(value: Column, i: Column) -> Column:
            gap = F.get(gaps, i)
            start = F.get(begins, i) + F.length(gap)
            return F.struct(
                start.alias("start"), (start + F.length(value)).alias("stop"), value.alias("value"), F.right(gap, F.lit(BEFORE_CHARS)).alias("before")
            )

        return F.transform(found, one)

    return F.when(F.size(found) > 0, _let(lengths, lambda x: _let(_running(x, _sum), spans))).otherwise(empty)


def _apart(spans: Column, others: Column) -> Column:
    """Of structs (start, stop, ...), those that have no place in common with any of ``others``."""

    def kept(events: Column) -> Column:
        # By the time a span stops, all others that begin before have been passed: does any of them reach beyond its start?
        reach = _let(F.transform(events, lambda e: e["reach"]), lambda r: _running(r, _largest))
        clear = lambda e, far: F.when(e["span"].isNotNull() & (far <= e["span"]["start"]), e["span"])
        return F.filter(_let(reach, lambda far: F.zip_with(events, far, clear)), lambda s: s.isNotNull())

    ends = F.transform(spans, lambda s: F.struct(s["stop"].cast("int").alias("at"), F.lit(0).alias("reach"), s.alias("span")))
    nothing = F.filter(spans, lambda s: F.lit(False))
    begins = F.transform(
        others, lambda o: F.struct(o["start"].cast("int").alias("at"), o["stop"].cast("int").alias("reach"), F.get(nothing, F.lit(0)).alias("span"))
    )
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(_let(F.sort_array(F.concat(ends, begins)), kept))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _fits(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(IP_FITS)
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _pattern(before: Column) -> Column:
    """What announces a value, in lower case and with single blanks; empty if nothing does."""
    return F.regexp_replace(F.lower(F.regexp_extract(before, BEFORE, 0)), r"[\x20\t]+", " ")


def with_matches(docs: DataFrame, text: str, kinds: dict[str, str], prefix: str) -> DataFrame:
    """``docs`` with a column ``prefix`` + kind of structs (start, stop, value, before) for each kind of pattern."""
    value = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns({f"{prefix}{k}_found": _found(value, p, NEEDS.get(k)) for k, p in kinds.items()})
    out = out.withColumns(
        {f"{prefix}{k}_gaps": F.when(F.size(f"{prefix}{k}_found") > 0, F.split(value, p, -1)) for k, p in kinds.items()}
    )
    return out.withColumns({f"{prefix}{k}": _placed(F.col(f"{prefix}{k}_found"), F.col(f"{prefix}{k}_gaps")) for k in kinds}).drop(
        *(f"{prefix}{k}{end}" for k in kinds for end in ("_found", "_gaps"))
    )


def _seed_kind(value: Column) -> Column:
    """The seed kind of a token; null if it isn't one."""
    out = F.when(value.rlike(SECRET_SEED), F.lit(SECRET))
    for kind in BASE:
        out = out.when(value.rlike(rf"^(?:{BASE[kind]})[.]?$") & _fits(kind, F.rtrim(value, F.lit("."))), F.lit(kind))
    return out


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def announced(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """digest (of the text), pattern, value, seed: what announcing patterns stand before.

    Values are the spans of all base kinds, which are seeds, and tokens. Tokens
    that touch a base span and aren't seeds themselves are left out, and so are
    base spans that touch a secret.
    """
    found = with_matches(docs.select(F.col(text)), text, BASE | {"token": TOKEN}, "pii_")

    def one(span: Column, seed: Column) -> Column:
        return F.struct(_pattern(span["before"]).alias("pattern"), span["value"].alias("value"), seed.cast("string").alias("seed"), span["start"].alias("start"), span["stop"].alias("stop"))

    def seeds(kind: str) -> Column:
        return F.transform(F.filter(f"pii_{kind}", lambda s: _fits(kind, s["value"])), lambda s: one(s, F.lit(kind)))

    found = found.withColumn("pii_base", F.concat(*(seeds(k) for k in BASE)))
    found = found.withColumn("pii_token", F.transform("pii_token", lambda s: one(s, _seed_kind(s["value"]))))
    found = found.withColumn("pii_seeds", F.filter("pii_token", lambda t: t["seed"].isNotNull()))
    found = found.withColumn("pii_others", F.filter("pii_token", lambda t: t["seed"].isNull()))
    found = found.withColumn("pii_secrets", F.filter("pii_seeds", lambda t: t["seed"] == SECRET))
    base = _apart(F.col("pii_base"), F.col("pii_secrets"))
    tokens = F.concat("pii_seeds", _apart(F.col("pii_others"), F.col("pii_base")))
    spots = found.select(_digest(text).alias("digest"), F.explode(F.concat(base, tokens)).alias("t"))
    return stored(spots.select("digest", "t.pattern", "t.value", "t.seed").where("pattern <> ''").distinct(), "pii-announced")


def confident_patterns(spots: DataFrame) -> DataFrame:
    """pattern, kind: all announcing patterns of high confidence and the kind of identifier that follows them.

    Counts run over distinct pairs of a pattern and a value in all texts, so
    copies count once. A pattern's confidence for a kind is the mean score of
    the values after it, with a doubt of DOUBT values. Known values of the kind
    score 1, others as far as any pattern before them is trusted. Values that
    score CONFIDENT or more are known from the next round on.
    """
    pairs = stored(spots.groupBy("pattern", "value").agg(F.min("seed").alias("seed")), "pii-pairs")
    totals = stored(pairs.groupBy("pattern").agg(F.count(F.lit(1)).alias("values")), "pii-totals")
    known = stored(pairs.where("seed is not null").select("value", F.col("seed").alias("kind")).distinct(), "pii-known")
    unseen = pairs.where("seed is null").select("pattern", "value")
    scores, before = known.withColumn("score", F.lit(1.0)), None
    for _ in range(ROUNDS):
        summed = pairs.join(scores, "value").groupBy("pattern", "kind").agg(
            F.sum("score").alias("score"), F.sum(F.when(F.col("score") == 1, 1).otherwise(0)).alias("hits")
        )
        patterns = summed.where(F.col("hits") >= LEAST_TOKENS).join(totals, "pattern")
        patterns = stored(patterns.select("pattern", "kind", (F.col("score") / (F.col("values") + DOUBT)).alias("confidence")), "pii-graph")
        # A value is as doubtful as all the patterns before it together.
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))
        believed = unseen.join(patterns, "pattern").groupBy("value", "kind").agg((1 - doubt).alias("score"))
        others = stored(believed.join(known, ["value", "kind"], "left_anti"), "pii-believed")
        fresh = others.where(F.col("score") >= CONFIDENT).select("value", "kind")
        mark = patterns.agg(F.count(F.lit(1)), F.round(F.sum("confidence"), 2)).first()
        if mark == before and not fresh.take(1):
            break
        known, before = known.unionByName(fresh), mark
        scores = known.withColumn("score", F.lit(1.0)).unionByName(others.where(F.col("score") < CONFIDENT))
    best = F.min_by("kind", F.struct(-F.col("confidence"), F.col("kind")))
    return stored(patterns.where(F.col("confidence") >= CONFIDENT).groupBy("pattern").agg(best.alias("kind")), "pii-patterns")


def learn_patterns(docs: DataFrame, *, text: str = "text") -> dict[str, str]:
    """The confident patterns of ``docs`` and their kinds, on the driver; ``find_pii`` keeps them as a table."""
    return {r["pattern"]: r["kind"] for r in confident_patterns(announced(docs, text=text)).collect()}


def find_pii(docs: DataFrame, patterns: dict[str, str] | DataFrame | None = None, *, text: str = "text") -> DataFrame:
    """``docs`` with ``pii_spans``: structs (kind, start, stop, base), by kind and start.

    Base kinds come first, in their order: email, ip, card, phone. Further
    kinds, by name: secret for seeds of that kind, and learned_ with a kind for
    tokens that a learned pattern announces. Further spans that touch a base
    span or an earlier further span are left out. ``patterns``, a dictionary or a
    table (pattern, kind), are learned from ``docs`` itself unless given. Places are in code points, stop exclusive.
    Null and empty texts have no spans; an input column pii_spans is replaced.
    """
    docs = without(docs, ["pii_spans"])
    kept = docs.columns
    spots = announced(docs, text=text)
    if patterns is None:
        patterns = confident_patterns(spots)
    elif isinstance(patterns, dict):
        patterns = docs.sparkSession.createDataFrame(sorted(patterns.items()), "pattern string, kind string")
    # The learned patterns of each text that has some; texts that are alike share them.
    pairs = spots.select("digest", "pattern").distinct().join(patterns, "pattern")
    learned = stored(pairs.groupBy(F.col("digest").alias("pii_digest")).agg(F.map_from_entries(F.collect_set(F.struct("pattern", "kind"))).alias("pii_learned")), "pii-learned")
    if learned.count() <= MAX_BROADCAST:
        learned = F.broadcast(learned)
    docs = docs.join(learned, _digest(text) == F.col("pii_digest"), "left").drop("pii_digest")
    found = with_matches(docs, text, BASE | {"token": TOKEN}, "pii_")

    def one(kind: Column, span: Column, base: bool) -> Column:
        return F.struct(
            kind.alias("kind"), span["start"].cast("long").alias("start"), span["stop"].cast("long").alias("stop"), F.lit(base).alias("base")
        )

    def kind_spans(kind: str) -> Column:
        fitting = F.filter(f"pii_{kind}", lambda s: _fits(kind, s["value"]))
        return F.transform(fitting, lambda s: one(F.lit(kind), s, True))

    base = F.concat(*(kind_spans(k) for k in BASE))

    def further_kind(span: Column) -> Column:
        kind = F.when(span["value"].rlike(SECRET_SEED), F.lit(SECRET))
        return kind.otherwise(F.concat(F.lit("learned_"), F.element_at("pii_learned", _pattern(span["before"]))))

    named = F.filter(F.transform("pii_token", lambda s: one(further_kind(s), s, False)), lambda s: s["kind"].isNotNull())
    found = found.withColumn("pii_base", base).withColumn("pii_further", named)
    ordered = F.array_sort(_apart(F.col("pii_further"), F.col("pii_base")))
    return found.select(*(F.col(f"`{c}`") for c in kept), F.concat("pii_base", ordered).alias("pii_spans"))


def _merged(spans: Column) -> Column:
    """Of structs (start, stop, kind) by start: those that no earlier one overlaps, up to where the ones that overlap them stop."""

    def of(far: Column) -> Column:
        first = F.filter(F.transform(spans, lambda s, i: F.when(s["start"] >= F.get(far, i), i)), lambda i: i.isNotNull())

        def one(places: Column) -> Column:
            def piece(i: Column, stop: Column) -> Column:
                return F.struct(F.get(spans, i)["start"].alias("start"), stop.alias("stop"), F.get(spans, i)["kind"].alias("kind"))

            last = F.size(places) - 1
            ends = F.array_max(F.transform(spans, lambda s: s["stop"]))
            inner = F.transform(F.slice(places, F.lit(1), last), lambda i, k: piece(i, F.get(far, F.get(places, k + 1))))
            return F.concat(inner, F.array(piece(F.get(places, last), ends)))

        return _let(first, one)

    return _let(F.transform(spans, lambda s: s["stop"]), lambda stops: _let(_running(stops, _largest), of))


def _rebuilt(text: Column, begin: Column, spans: Column, depth: int = 1) -> Column:
    """``text``, which begins at the place ``begin`` and ends where the last of ``spans`` stops, with each of them replaced."""

    def between(a: Column, b: Column) -> Column:
        return F.substr(text, (a - begin + 1).cast("int"), (b - a).cast("int"))

    def after(some: Column, i: Column) -> Column:
        return F.when(i > 0, F.get(some, i - 1)["stop"]).otherwise(begin)

    def plain(span: Column, i: Column) -> Column:
        return F.concat(between(after(spans, i), span["start"]), F.lit("["), F.upper(span["kind"]), F.lit("]"))

    simple = F.array_join(F.transform(spans, plain), "")
    if not depth:
        return simple

    def in_chunks(chunks: Column) -> Column:
        def part(chunk: Column, i: Column) -> Column:
            start = F.when(i > 0, F.element_at(F.get(chunks, i - 1), -1)["stop"]).otherwise(begin)
            return _let(F.struct(start.alias("start"), between(start, F.element_at(chunk, -1)["stop"]).alias("text")), lambda c: _rebuilt(c["text"], c["start"], chunk, depth - 1))

        return F.array_join(F.transform(chunks, part), "")

    return F.when(F.size(spans) <= CHUNK, simple).otherwise(_let(_chunks(spans), in_chunks))


def redact(found: DataFrame, *, text: str = "text") -> DataFrame:
    """The rows of ``find_pii`` with each span in the text replaced by its kind in brackets.

    Of overlapping spans, the first by start is named, and all that they cover
    goes. A null text stays null; ``pii_spans`` goes, other columns stay.
    """
    value = F.col(f"`{text}`")
    spans = F.array_sort(F.transform("pii_spans", lambda s: F.struct(s["start"].cast("int").alias("start"), s["stop"].cast("int").alias("stop"), s["kind"].alias("kind"))))

    def whole(merged: Column) -> Column:
        end = F.element_at(merged, -1)["stop"]
        return F.concat(_rebuilt(F.substr(value, F.lit(1), end), F.lit(0), merged), F.substr(value, end + 1))

    rebuilt = _let(spans, lambda s: _let(_merged(s), whole))
    return found.withColumn(text, F.when(F.size("pii_spans") > 0, rebuilt).otherwise(value)).drop("pii_spans")

"""Personal data by rules and by bootstrapped contexts, with DataFrame operations alone.

Rules find e-mail addresses, IP addresses, card and phone numbers; a format finds the surest secrets. These
seed a graph of patterns (words beside an identifier, the identifier's shape) and instances (identifiers and
other tokens that look like some). Rounds of scoring pass confidence from instances to patterns and back,
until nothing new is found; tokens that stand in patterns of high confidence, and that could be of the
pattern's kind, are found as identifiers that no rule knows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import discard, materialise

#: Kinds in the order that breaks ties of start. The rules' own come first; secrets are the method's.
KINDS = ("email", "ip", "card", "phone", "secret")
RULED = KINDS[:4]
#: What each kind looks like, written so that no text makes the matcher retry within a run.
#: A match that could start inside a run of its first class would have started before it, so only a
#: run's start or the end of the last match need be tried.
SHAPES = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for at all.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Other tokens that may turn out to be identifiers: a word with a digit or an at sign, of LOOKS.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
LEADING, TRAILING = r"^[\"'(<\[{]+", r"[\"')>\]},.;:!?#$%&*|~]+$"
#: Characters beside an identifier in which its neighbours are read.
WINDOW = 64
#: Confidence from which patterns and instances count as sure, and the mass of sure instances that a pattern needs.
SURE, SUPPORT = 0.8, 3.0
#: What a token of no known kind counts against a pattern, where one of another kind counts 1.
UNKNOWN = 0.25
#: What a pattern has against it before anything is counted.
DOUBT = 0.5
#: How much more often than behind any word a kind must stand by a word for that word to say something.
LIFT = 20.0
#: Most words that are broadcast to be counted.
WORDS_BROADCAST = 200_000
#: Most discovered tokens that are broadcast.
TOKENS_BROADCAST = 200_000


def between(text: str, shape: str, needs: str) -> tuple[str, str]:
    """SQL of the matches of a shape and of the pieces of text around them."""
    shape = shape.replace("\\", "\\\\").replace("'", "\\'")
    return (
        f"if({needs}, regexp_extract_all({text}, '{shape}', 0), cast(array() as array<string>))",
        f"if({needs}, split({text}, '{shape}', -1), cast(array() as array<string>))",
    )


def places(found: str, pieces: str) -> Column:
    """Matches with their places (code points, end exclusive) and the text next to them."""
    return F.expr(f"""
        transform({found}, (m, i) -> named_struct(
            'start', aggregate(slice(gaps, 1, i + 1), 0L, (a, x) -> a + x) + aggregate(slice(widths, 1, i), 0L, (a, x) -> a + x),
            'width', cast(char_length(m) as bigint), 'token', m,
            'before', right(element_at({pieces}, i + 1), {WINDOW}), 'after', left(element_at({pieces}, i + 2), {WINDOW})))""")


LUHN = """
    aggregate(transform(split(reverse(regexp_replace(x.token, '[^0-9]', '')), ''),
        (c, i) -> if(i % 2 = 0, cast(c as int), if(cast(c as int) > 4, cast(c as int) * 2 - 9, cast(c as int) * 2))), 0, (a, v) -> a + v) % 10 = 0
"""
DIGITS = "char_length(regexp_replace(x.token, '[^0-9]', ''))"
#: Tokens that are looked at besides the rules' matches.
LOOKS = f"(contains(x.token, '@') or {DIGITS} >= 5 or x.token rlike '^[0-9a-f]*:[0-9a-f]*:[0-9a-f:]+$')"
#: The surest secrets, which seed the others: 40 hexadecimal digits, as of a SHA-1, letters and digits mixed.
SEED_SECRET = "(char_length(x.token) = 40 and x.token rlike '^[0-9a-f]+$' and x.token rlike '[0-9]' and x.token rlike '[a-f]')"
VALID = {
    "email": "true",
    "ip": "forall(split(x.token, '[.]'), p -> char_length(ltrim('0', p)) <= 3 and cast(concat('0', right(p, 3)) as int) <= 255)",
    "card": f"case when {DIGITS} between 12 and 19 then {LUHN} else false end",
    "phone": f"{DIGITS} between 9 and 15",
}
#: What a token must be like to be taken for a kind that no rule found it to be. A number that fails the
#: cards' check digit is none, whatever stands beside it.
FITS = {
    "email": "contains(x.token, '@')",
    "ip": "x.token rlike '^[0-9a-f]*[.:][0-9a-f]*[.:][0-9a-f.:\\\\[\\\\]]+(/[0-9]+)?$' and not contains(x.token, '@')",
    "card": f"not x.token rlike '[a-z@+]' and {VALID['card']}",
    "phone": f"not x.token rlike '[a-z@]' and {DIGITS} between 7 and 15",
    "secret": f"char_length(x.token) >= 16 and x.token rlike '[0-9]' and x.token rlike '[a-z]' and x.token rlike '^[a-z0-9_+/=.-]+$' and not x.token rlike '^[a-z]*[.-]?[0-9]{{1,4}}$'",
}


def matches(rows: DataFrame) -> DataFrame:
    """Columns id, base (places of all rules' matches, with their kinds) and others (further tokens)."""
    has_digit = F.col("text").rlike("[0-9]")
    rows = rows.select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digit", has_digit)
    spans, needs_of = {}, {k: "digit" + (f" and contains(text, '{v}')" if v else "") for k, v in NEEDS.items()} | {"email": "contains(text, '@')", "token": "digit or contains(text, '@')"}
    for kind, shape in [*SHAPES.items(), ("token", TOKEN)]:
        found, pieces = between("text", shape, needs_of[kind])
        rows = rows.withColumn("found", F.expr(found)).withColumn("pieces", F.expr(pieces))
        rows = rows.withColumn("gaps", F.expr("transform(pieces, x -> cast(char_length(x) as bigint))")).withColumn("widths", F.expr("transform(found, x -> cast(char_length(x) as bigint))"))
        spans[kind] = f"at_{kind}"
        rows = rows.withColumn(spans[kind], places("found", "pieces")).drop("found", "pieces", "gaps", "widths")
        if kind != "token":
            rows = rows.withColumn(
                spans[kind],
                F.expr(f"transform(filter({spans[kind]}, x -> {VALID[kind]}), x -> named_struct('start', x.start, 'rank', {KINDS.index(kind)}, 'end', x.start + x.width, 'kind', '{kind}', 'token', lower(x.token), 'before', x.before, 'after', x.after))"),
            )
    base = F.array_sort(F.concat(*(F.col(spans[k]) for k in RULED)))
    trimmed = f"""
        transform(at_token, x -> named_struct('start', x.start + char_length(x.token) - char_length(regexp_replace(x.token, '{LEADING.replace("'", chr(92) + "'")}', '')),
            'token', lower(regexp_replace(regexp_replace(x.token, '{LEADING.replace("'", chr(92) + "'")}', ''), '{TRAILING.replace("'", chr(92) + "'")}', '')), 'before', x.before, 'after', x.after))
    """.replace("\\[", "\\\\[").replace("\\]", "\\\\]")
    rows = rows.withColumn("base", base).withColumn("at_token", F.expr(trimmed))
    others = F.expr(f"""
        filter(at_token, x -> {LOOKS}
            and not exists(base, b -> b.start < x.start + char_length(x.token) and x.start < b.end))""")
    return rows.select("id", "base", others.alias("others"))


def shape_of(token: Column) -> Column:
    """A token's form: hexadecimal strings and long numbers by their length, other letters and digits as runs."""
    plain = F.regexp_replace(F.regexp_replace(token, "[0-9]+", "9"), "[a-z\\P{ASCII}]+", "a")
    long_number = token.rlike(r"^[0-9 -]{10,}$")
    hexadecimal = (F.char_length(token) >= 16) & token.rlike("^[0-9a-f]+$") & token.rlike("[a-f]")
    digits = F.regexp_replace(token, "[^0-9]", "")
    return F.when(hexadecimal, F.concat(F.lit("h"), F.char_length(token).cast("string"))).when(long_number, F.concat(F.lit("n"), F.char_length(digits).cast("string"))).otherwise(plain)


def graph(found: DataFrame, hidden: float = 0.0, seed: int = 10) -> DataFrame:
    """Edges of patterns and instances: pattern, words, token, kind (null: not known), fits (kinds it may turn out to be).

    Patterns are the word before (L), the two before (LL), the word behind (R) and the shape (S); ``words`` are
    those that a pattern consists of. ``hidden`` is the share of seeds, by hash of the token, whose kinds are
    left out, for measuring.
    """
    units = found.select(F.expr(f"""
        explode(concat(transform(base, x -> named_struct('token', x.token, 'kind', x.kind, 'before', x.before, 'after', x.after)),
                       transform(others, x -> named_struct('token', x.token, 'kind', if({SEED_SECRET}, 'secret', null), 'before', x.before, 'after', x.after)))) as x"""))
    kind = F.when(F.pmod(F.xxhash64(F.lit(seed), "x.token"), F.lit(1000)) >= int(1000 * hidden), F.col("x.kind"))
    fits = F.array_compact(F.array(*(F.expr(f"if({FITS[k]}, '{k}', null)") for k in KINDS)))
    units = units.select("x.token", kind.alias("kind"), "x.before", "x.after", fits.alias("fits"))
    one = F.lower(F.regexp_extract("before", r"(\S+)\s+$", 1))
    far = F.lower(F.regexp_extract("before", r"(\S+)\s+\S+\s+$", 1))
    right = F.lower(F.regexp_extract("after", r"^\S*\s+(\S+)", 1))
    pattern = lambda mark, *words: F.struct(F.concat_ws(" ", F.lit(mark), *words).alias("pattern"), F.array(*words).alias("words"))
    patterns = F.array(
        F.when(one != "", pattern("L", one)),
        F.when(far != "", pattern("LL", far, one)),
        F.when(right != "", pattern("R", right)),
        F.struct(F.concat(F.lit("S "), shape_of(F.col("token"))).alias("pattern"), F.array().cast("array<string>").alias("words")),
    )
    return units.select("token", "kind", "fits", F.explode(F.array_compact(patterns)).alias("p")).select("p.pattern", "p.words", "token", "kind", "fits").distinct()


def occurrences(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """How often the patterns of words may stand in all texts: pattern, times, total (words in all).

    A pattern of two words stands at most as often as its rarer word does; that bound is taken. Patterns with
    fewer than SUPPORT tokens can't be trusted and aren't counted. Words are counted within tasks first.
    """
    wanted = edges.where(F.size("words") > 0).groupBy("pattern").agg(F.first("words").alias("words"), F.count_distinct("token").alias("tokens"))
    wanted = materialise(wanted.where(F.col("tokens") >= SUPPORT).select("pattern", "words"), "wanted")
    words = materialise(wanted.select(F.explode("words").alias("wanted")).distinct(), "words")
    spoken = texts.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+")).alias("word")).where("word != ''")
    if words.count() <= WORDS_BROADCAST:
        spoken = spoken.join(F.broadcast(words), F.col("word") == F.col("wanted"), "left").select(F.col("wanted").alias("word"))
    counts = materialise(spoken.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    times = wanted.select("pattern", F.explode("words").alias("word")).join(counts, "word").groupBy("pattern").agg(F.min("n").alias("times"))
    heard = materialise(times.withColumn("total", F.lit(total).cast("long")), "heard")
    discard(wanted, words, counts)
    return heard


def pattern_scores(edges: DataFrame, belief: DataFrame, heard: DataFrame) -> DataFrame:
    """Patterns by kind: pattern, kind, mass, trust. ``belief``: token, kind, belief. ``heard``: as of occurrences.

    Trust is the believed mass of the kind over itself, plus the mass of other kinds, plus UNKNOWN for each
    token that might be of the kind and that nothing is believed of, plus DOUBT. So a pattern of one kind is
    trusted though some of its tokens are unseen, and one that all kinds share isn't. Words must also stand
    by the kind LIFT times as often as the kind stands anywhere, which common words never do.
    """
    held = edges.select("pattern", "token", "fits").distinct().join(belief, "token", "left")
    masses = held.where("kind is not null").groupBy("pattern", "kind").agg(F.sum("belief").alias("mass"))
    every = masses.groupBy("pattern").agg(F.sum("mass").alias("every"))
    masses = masses.where(F.col("mass") >= SUPPORT).join(every, "pattern")
    open_ = held.where("kind is null").select("pattern", F.explode("fits").alias("kind")).groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("open"))
    kinds = belief.groupBy("kind").agg(F.sum("belief").alias("of_kind"))
    rows = masses.join(open_, ["pattern", "kind"], "left").join(F.broadcast(kinds), "kind").join(heard, "pattern", "left")
    trust = F.col("mass") / (F.col("every") + UNKNOWN * F.coalesce("open", F.lit(0)) + DOUBT)
    lift = F.col("mass") * F.col("total") / (F.col("times") * F.col("of_kind"))
    said = F.startswith("pattern", F.lit("S ")) | (lift >= LIFT)
    return rows.where(said).select("pattern", "kind", "mass", trust.alias("trust"))


def instance_scores(edges: DataFrame, sure: DataFrame) -> DataFrame:
    """Tokens of unknown kind by their sure patterns: token, kind (the best that fits), confidence (noisy-or of the patterns' trust)."""
    open_ = edges.where("kind is null").select("token", "pattern", F.explode("fits").alias("kind")).distinct()
    doubt = F.log1p(-F.least("trust", F.lit(0.999)))
    scored = open_.join(sure, ["pattern", "kind"]).groupBy("token", "kind").agg((1 - F.exp(F.sum(doubt))).alias("confidence"))
    return scored.groupBy("token").agg(F.max(F.struct("confidence", "kind")).alias("best")).select("token", "best.kind", "best.confidence")


def bootstrap(edges: DataFrame, heard: DataFrame) -> DataFrame:
    """Tokens that reach confidence SURE: token, kind, confidence (1 for seeds, which a rule may miss in other places).

    Rounds go on until one finds no token that wasn't found before. What is found stays found with the
    confidence it had, so the number of rounds is bounded by that of tokens; a few suffice.
    """
    known = materialise(edges.where("kind is not null").groupBy("token").agg(F.min("kind").alias("kind")).withColumn("belief", F.lit(1.0)), "seeds")
    found, number, turn = known.limit(0), 0, 0
    while True:
        belief = known.unionByName(found)
        sure = materialise(pattern_scores(edges, belief, heard).where(F.col("trust") >= SURE).select("pattern", "kind", "trust"), f"patterns{turn}")
        best = instance_scores(edges, sure).where(F.col("confidence") >= SURE)
        new = best.join(known.select("token"), "token", "left_anti").join(found.select("token"), "token", "left_anti")
        more = materialise(found.unionByName(new.withColumnRenamed("confidence", "belief")), f"instances{turn}")
        discard(sure, *([found] if turn else []))
        found, before, number, turn = more, number, more.count(), turn + 1
        if number == before:
            break
    return found.unionByName(known).withColumnRenamed("belief", "confidence")


def joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, base and extra (arrays of start, rank, end, kind), spans (both, in order).

    Places are code points, ends exclusive. ``base`` holds the rules' matches, ``extra`` secrets and the tokens
    that only their contexts gave away; none overlaps a rule's match. Null and empty texts have none, an empty
    table gives an empty result. Rows of one id share what was discovered under it, so ids should be unique.
    Of kinds with equal confidence the last by name wins. Other columns are neither read nor returned.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = materialise(matches(texts), "matches")
    edges = materialise(graph(found.where("size(base) > 0 or size(others) > 0")), "edges")
    heard = occurrences(edges, texts)
    discovered = bootstrap(edges, heard)
    discard(edges, heard)
    discovered = F.broadcast(discovered) if discovered.count() <= TOKENS_BROADCAST else discovered
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    extra = (
        found.where("size(others) > 0").select("id", F.explode("others").alias("x")).select("id", "x.start", "x.token")
        .join(discovered, "token")
        .groupBy("id").agg(F.array_distinct(F.collect_list(F.struct("start", rank.alias("rank"), (F.col("start") + F.char_length("token")).alias("end"), "kind"))).alias("extra"))
    )
    plain = F.expr("transform(base, x -> named_struct('start', x.start, 'rank', x.rank, 'end', x.end, 'kind', x.kind))")
    rows = found.select(F.col("id"), plain.alias("base")).join(extra.withColumnRenamed("id", "own"), F.col("id") == F.col("own"), "left").drop("own")
    rows = rows.withColumn("extra", F.expr("coalesce(extra, filter(base, x -> false))"))
    return rows.withColumn("spans", F.array_sort(F.concat("base", "extra"))).withColumnRenamed("id", id_col)


def hidden_seeds(docs: DataFrame, share: float = 0.3, seed: int = 10, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How well contexts find what they weren't told: kind, hidden, found (as that kind), claimed (tokens said to be of it).

    A share of the seeds, by hash, isn't told; what the rounds then say of tokens without a known kind is held
    against the rules. Recall is found over hidden; precision, where every token that no rule knows counts as
    wrong, found over claimed.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = materialise(matches(texts).where("size(base) > 0 or size(others) > 0"), "matches")
    truth = graph(found).where("kind is not null").groupBy("token").agg(F.min("kind").alias("truth"))
    edges = materialise(graph(found, share, seed), "edges")
    told = edges.where("kind is not null").select("token").distinct()
    said = bootstrap(edges, occurrences(edges, texts)).select("token", "kind").join(told, "token", "left_anti")
    rows = truth.join(told, "token", "left_anti").join(said, "token", "full")
    right = F.col("kind") == F.col("truth")
    by = rows.select(F.explode(F.array_compact(F.array_distinct(F.array("truth", "kind")))).alias("of"), "truth", "kind", right.alias("right"))
    return by.groupBy(F.col("of").alias("kind")).agg(F.count_if(F.col("truth") == F.col("of")).alias("hidden"), F.count_if(F.col("right")).alias("found"), F.count_if(F.col("kind") == F.col("of")).alias("claimed"))

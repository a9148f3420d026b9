"""Personal data, by base patterns and bootstrapped contextual extraction. DataFrame functions only.

Base patterns find e-mail and IP addresses, card and phone numbers. They are the
seeds of the bootstrap, each span with its whole value. Other identifiers are, in
the text outside all base spans, runs of letters, digits and ``@._%+-`` with a
digit in them, and groups of digits (up to eight) with spaces, slashes or
parentheses between them. The word and the two words before an identifier are its
lexical patterns (whole words of the text since the match before it, none with
digits), and patterns and identifiers form a bipartite graph. A pattern's score
is the summed score of its distinct identifiers over their number + 0.5, an
identifier's is 1 if a base span holds it, else its best pattern's; ROUNDS rounds
spread the scores. They are few on purpose: at the fixpoint the identifiers that
a pattern found would confirm it, however many they are. Patterns count only with
SEEDS distinct seeds. Identifiers outside all base spans, of VALUE characters or
more (shorter ones are numbers of pages and the like), with a pattern of
THRESHOLD or more are reported as ``context``.

To find positions with string functions, matches are set between two private-use
characters; such characters in a text are first replaced by another one of the
same length. Patterns have no nested repeats, so that long texts can't overflow
a stack: characters that end a repeat are marked beforehand instead. Running sums
and cuts go by chunks, so that a text full of matches costs no square of them.

Spans are in code points, end exclusive. Null and empty texts have no spans;
repeated rows give equal rows; a null doc_id stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, shared_table

KINDS = ("email", "ip", "card", "phone")
ROUNDS, SEEDS, THRESHOLD, VALUE = 3, 3, 0.8, 4
#: Array elements, and characters, of a chunk.
CHUNK, CUT = 512, 8192
OPEN, CLOSE, DEAD, SPACE, DASH = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"
EMAIL = rf"(?:(?<![A-Za-z0-9._%+{DEAD}-])|\G)[A-Za-z0-9._%+{DEAD}-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
CARD = rf"[0-9][0-9{SPACE}{DASH}]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
NUMBER = r"\+?(?:[0-9][0-9.-]*+|\([0-9]++\))(?:\x20?\([0-9]++\)|[\x20/]?[0-9][0-9.-]*+){1,7}+(?![A-Za-z0-9@_%+])"
IDENTIFIER = rf"(?<![A-Za-z0-9@._%+-])(?:{NUMBER}|[A-Za-z@._%+-]*+[0-9][A-Za-z0-9@._%+-]*+)"
SPAN = "array<struct<start:int,end:int,match:string>>"


def marked(text: Column, pattern: str, only: Column) -> Column:
    """The pieces of a text, every other one a match; NULL where ``only`` doesn't hold or nothing matches."""
    pieces = F.split(F.when(only, F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}")), f"[{OPEN}{CLOSE}]")
    return F.when(F.size(pieces) > 1, pieces)


def running(items: Column, step) -> Column:
    """[0, step(0, first item), step(that, second item), ...]; only a chunk's results are copied for each item."""

    def chunk(a: Column, c: Column) -> Column:
        own = F.aggregate(F.slice(items, c * CHUNK + 1, F.lit(CHUNK)), F.array(a["at"]), lambda x, item: F.concat(x, F.array(step(F.element_at(x, -1), item))))
        return F.struct(F.concat(a["out"], F.array(F.slice(own, 2, CHUNK))).alias("out"), F.element_at(own, -1).alias("at"))

    none = F.struct(F.array(F.array(F.lit(0))).alias("out"), F.lit(0).alias("at"))
    made = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), none, chunk)
    return F.when(F.size(items) > 0, F.flatten(made["out"]))


def sums(pieces: Column) -> Column:
    """[0, length of the first piece, of the first two, ...] in code points."""
    return running(pieces, lambda n, piece: n + F.length(piece))


def spans(pieces: Column, ends: Column, plain) -> Column:
    """(start, end, match, before) of the pieces that are matches; before is the text since the match before, behind a CLOSE if there is one. ``plain`` gives a piece's own characters back."""

    def one(i: Column) -> Column:
        before = plain(F.get(pieces, i - 1))
        return F.struct(F.get(ends, i).alias("start"), F.get(ends, i + 1).alias("end"), plain(F.get(pieces, i)).alias("match"), F.when(i > 1, F.concat(F.lit(CLOSE), before)).otherwise(before).alias("before"))

    return F.transform(F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)), one)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(number)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(number, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _with_base(docs: DataFrame) -> DataFrame:
    """docs with ``t``, the text without reserved characters, and ``base``."""
    df = docs.withColumn("t", F.translate("text", OPEN + CLOSE + DEAD + SPACE + DASH, "\ufffd" * 5))
    t = F.col("t")
    number = t.rlike("[0-9]")
    live = F.regexp_replace(F.regexp_replace(t, "(?<=[0-9])\x20(?=[0-9])", SPACE), "(?<=[0-9])-(?=[0-9])", DASH)
    df = df.withColumns({
        "p_email": marked(F.regexp_replace(t, r"\.(?![A-Za-z0-9-])", DEAD), EMAIL, t.contains("@")),
        "p_ip": marked(t, IP, number),
        "p_card": marked(live, CARD, t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")),
        "p_phone": marked(t, PHONE, t.contains("+")),
    })
    df = df.withColumns({f"e_{k}": sums(F.col(f"p_{k}")) for k in KINDS})
    legal = {
        "email": lambda m: F.lit(True),
        "ip": lambda m: m.rlike(rf"^(?:{PART}\.){{3}}{PART}$"),
        "card": lambda m: F.length(digits(m)).between(13, 19) & luhn(digits(m)),
        "phone": lambda m: F.length(digits(m)).between(9, 15),
    }
    plain = {"email": lambda p: F.translate(p, DEAD, "."), "card": lambda p: F.translate(p, SPACE + DASH, "\x20-")}

    def found(kind: str) -> Column:
        ok = F.filter(spans(F.col(f"p_{kind}"), F.col(f"e_{kind}"), plain.get(kind, lambda p: p)), lambda s: legal[kind](s["match"]))
        made = F.transform(ok, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("value"), _patterns(s["before"]).alias("patterns")))
        return F.coalesce(made, F.array().cast("array<struct<kind:string,start:int,end:int,value:string,patterns:array<string>>>"))

    df = df.withColumn("base", F.concat(*(found(k) for k in KINDS)))
    df = df.withColumns({
        "order": F.array_sort(F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end")))),
        "chunks": F.when(F.size("base") > 0, F.transform(F.sequence(F.lit(0), F.floor((F.length(t) - 1) / CUT).cast("int")), lambda i: F.substring(t, i * CUT + 1, F.lit(CUT)))),
    })
    df = df.withColumn("upto", running(F.col("order"), lambda at, b: F.greatest(at, b["end"])))
    df = df.withColumn("p_id", marked(_without(t), IDENTIFIER, number))
    return df.withColumn("e_id", sums(F.col("p_id")))


def cut(chunks: Column, a: Column, b: Column) -> Column:
    """The characters from a to b of a text in chunks of CUT."""
    i, j = F.floor(a / CUT).cast("int"), F.floor(b / CUT).cast("int")
    several = F.concat(F.substring(F.get(chunks, i), a - i * CUT + 1, F.lit(CUT)), F.array_join(F.slice(chunks, i + 2, j - i - 1), ""), F.coalesce(F.substring(F.get(chunks, j), F.lit(1), b - j * CUT), F.lit("")))
    return F.when(a >= b, "").when(i == j, F.substring(F.get(chunks, i), a - i * CUT + 1, b - a)).otherwise(several)


def _without(text: Column) -> Column:
    """The text with a DEAD for every character of a base span: by ``order``, the base spans by start, and ``upto``, the ends up to each."""
    order, upto, chunks = F.col("order"), F.col("upto"), F.col("chunks")

    def part(b: Column, i: Column) -> Column:
        at = F.get(upto, i)
        return F.concat(cut(chunks, at, b["start"]), F.repeat(F.lit(DEAD), F.greatest(b["end"] - F.greatest(b["start"], at), F.lit(0))))

    return F.when(F.size(order) == 0, text).otherwise(F.concat(F.array_join(F.transform(order, part), ""), cut(chunks, F.element_at(upto, -1), F.length(text))))


def _patterns(before: Column) -> Column:
    """The last word and the last two words of what stands before an identifier; none with digits, and none that a match or base span reaches into."""
    last = F.when(before.rlike(r"\s\z"), F.substring_index(F.rtrim(F.regexp_replace(F.lower(before), r"\s++", "\x20")), "\x20", -2))
    words = lambda w: F.filter(F.array(F.substring_index(w, "\x20", -1), F.when(w.contains("\x20"), F.ltrim(w))), lambda p: (p != "") & ~p.rlike(f"[0-9{DEAD}{CLOSE}]"))
    none = F.array().cast("array<string>")
    # bound by a lambda, so that the text is looked at once
    return F.coalesce(F.get(F.transform(F.array(last), lambda w: F.when(w.isNotNull(), F.array_distinct(words(w)))), 0), none)


def _identifiers(pieces: Column, ends: Column, base: Column) -> Column:
    """Base spans, and identifiers outside them, that have patterns: (start, end, value, patterns, seed)."""

    def new(s: Column) -> Column:
        value = F.regexp_replace(s["match"], "^[@._%+-]+|[@._%+-]+$", "")
        start = s["start"] + F.length(s["match"]) - F.length(F.regexp_replace(s["match"], "^[@._%+-]+", ""))
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), _patterns(s["before"]).alias("patterns"), F.lit(False).alias("seed"))

    def seed(b: Column) -> Column:
        return F.struct(b["start"].alias("start"), b["end"].alias("end"), b["value"].alias("value"), b["patterns"].alias("patterns"), F.lit(True).alias("seed"))

    none = F.array().cast("array<struct<start:int,end:int,value:string,patterns:array<string>,seed:boolean>>")
    found = F.when(pieces.isNotNull(), F.transform(spans(pieces, ends, lambda p: p), new))
    return F.filter(F.concat(F.transform(base, seed), F.coalesce(found, none)), lambda x: (F.size(x["patterns"]) > 0) & (x["seed"] | (F.length(x["value"]) >= VALUE)))


def patterns(instances: DataFrame, rounds: int = ROUNDS, seeds: int = SEEDS) -> DataFrame:
    """(pattern, score) of (pattern, value, seed) rows."""
    edges = instances.groupBy("pattern", "value").agg(F.max("seed").alias("seed"))
    known = edges.groupBy("value").agg(F.max("seed").alias("known"))
    edges = edges.drop("seed").join(known, "value")
    enough = edges.groupBy("pattern").agg(F.count_if("known").alias("n")).where(F.col("n") >= seeds).select("pattern")
    edges = shared_table(edges.join(enough, "pattern", "left_semi"), "edges")
    values = edges.groupBy("value").agg(F.max(F.col("known").cast("double")).alias("v"))
    for _ in range(rounds):
        scores = edges.join(values, "value").groupBy("pattern").agg((F.sum("v") / (F.count("*") + 0.5)).alias("score"))
        scores = shared_table(scores, "scores")
        values = edges.join(scores, "pattern").groupBy("value").agg(F.max(F.when(F.col("known"), 1.0).otherwise(F.col("score"))).alias("v"))
    return scores


def find(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, extra): arrays of (kind, start, end), the base spans by kind as listed and start."""
    docs = _with_base(pick(df, id_col, text_col))
    only = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    held = docs.select("doc_id", "text", only.alias("base"), _identifiers(F.col("p_id"), F.col("e_id"), F.col("base")).alias("ids"))
    key = F.when(F.size("ids") > 0, F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.sha2("text", 256)))
    held = shared_table(held.select("doc_id", key.alias("row"), "base", "ids"), "identifiers")
    instances = held.where("row is not null").select("row", F.explode("ids").alias("i")).select("row", "i.*").withColumn("pattern", F.explode("patterns")).drop("patterns")
    good = patterns(instances).where(F.col("score") >= threshold).select("pattern")
    new = instances.where("not seed").join(good, "pattern", "left_semi").groupBy("row").agg(F.array_sort(F.collect_set(F.struct(F.lit("context").alias("kind"), "start", "end"))).alias("extra"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return held.select("doc_id", "row", "base").join(new, "row", "left").select("doc_id", "base", F.coalesce("extra", none).alias("extra"))


def digests(found: DataFrame) -> DataFrame:
    """Counts and digests of find()'s spans."""
    line = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(F.concat("base", "extra")).alias("spans"))

"""Personal data by bootstrapped contextual extraction.

1. Base entities (email, ip, card, phone) are found by fixed patterns over
   every whole text.  Every other token that looks like an identifier (it holds
   a digit or an @) is a candidate.
2. Each found or candidate token is an occurrence of an instance (its value) in
   a lexical pattern (the two words or the key before it, and what follows).
   Seeds are the base entities and tokens of well-known secret formats.
3. Spark scores the pattern-instance graph in rounds: a pattern's confidence
   for a kind is the smoothed share of its instances that are of that kind, an
   instance's is 1 minus the product of its patterns' doubts.  Both are
   aggregations and equi-joins over distinct (pattern, instance) edges.
4. Patterns of high confidence and enough distinct instances of the kind
   extract the candidates that stand in them and have the kind's shape.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlake.session import drop_scratch, materialize

KINDS = ("email", "ip", "card", "phone", "secret")
ROUNDS = 3
#: A pattern extracts from this confidence and number of distinct known instances on.
MIN_CONFIDENCE = 0.8
MIN_INSTANCES = 5
#: Weight of doubt in a pattern's share.
PRIOR = 1.0

_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-".decode())
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP_TAIL = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A candidate is a maximal run of these characters that holds a digit or an @.
_TOKEN = re.compile(r"[^\s\"'<>()\[\]{},;=:|]+")
_MARK = re.compile(r"[0-9@]")
#: Formats that seed the kind "secret": a cloud access key id, long hexadecimal keys.
_SECRET = re.compile(r"AKIA[0-9A-Z]{16}$|(?=.*[0-9])(?=.*[a-f])[0-9a-f]{16,}$|(?=.*[0-9])(?=.*[A-F])[0-9A-F]{16,}$")
#: Shorter candidates than this are of no kind (see _SHAPE), and the characters
#: before a candidate in which its pattern is looked for.
MIN_CHARS, CONTEXT = 6, 48
#: What a candidate must look like to be taken as a kind.
_SHAPE = {
    "email": r"^[^@]+(@|\(at\)|\[at\])[^@]+$",
    "ip": r"^[0-9a-fA-F]{1,4}([.:][0-9a-fA-F]{0,4}){3,7}$",
    "card": r"^[0-9]([ .-]?[0-9]){11,18}$",
    "phone": r"^[0-9][0-9./-]{5,}[0-9]$",
    "secret": r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_+/.-]{8,}$",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all base entities by start, then kind as listed.
    Equal to leftmost non-overlapping matching per kind, in time linear in the
    text: matches are tried where a run of digits or an @ stands."""
    out: list[tuple[int, int, int]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            out.append((lo, 0, m.end()))
            done = m.end()
        else:
            done = max(done, at)              # runs before this @ cannot reach a later one
        at = text.find("@", max(done, at + 1))
    ip_end = card_end = 0
    for run in _DIGITS.finditer(text):
        i = run.start()
        if i >= ip_end and (m := _IP_TAIL.match(text, i)):
            ip_end = m.end()
            if all(len(x) < 4 and int(x or 0) <= 255 for x in (p.lstrip("0") for p in m.group().split("."))):
                out.append((i, 1, ip_end))
        if i >= card_end and (m := _CARD.match(text, i)):
            card_end = m.end()
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((i, 2, card_end))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return [(s, e, KINDS[k]) for s, k, e in sorted(out)]


def span_text(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


_BEFORE = re.compile(r"(?:(\S+)\s+)?(\S+[=:]\s*[\"']?|\S*\s*[=:]\s*[\"']?|\S+\s+[\"'(<\[]?)$")


def pattern_of(text: str, start: int, end: int) -> str | None:
    """The lexical pattern of an occurrence: the key or the two words before
    it, lower-cased, digits as 0, and the character after it."""
    left = text[max(0, start - CONTEXT):start]
    m = _BEFORE.search(left)
    if not m:
        return None
    word, key = (m.group(1) or "").lower(), " ".join(m.group(2).lower().split())
    if not re.search(r"[^\W\d_]", word + key):
        return None
    after = text[end:end + 1]
    after = after if after and after in "\"')>]};,." else "_"
    before = key if key.rstrip("\"' ").endswith(("=", ":")) else f"{word} {key}"
    return re.sub(r"[0-9]+", "0", before) + " <> " + after


def occurrences(text: str) -> tuple[list[tuple[int, int, str]], list[tuple]]:
    """Base spans, and (start, end, kind or None, value, pattern) of base
    entities and of candidate tokens that overlap none (a seed also without a pattern)."""
    spans = base_spans(text)
    found: list[tuple] = []
    covered = bytearray()
    if spans:
        covered = bytearray(max(e for _, e, _ in spans) + 1)
        for s, e, k in spans:
            covered[s:e] = b"\1" * (e - s)
            if p := pattern_of(text, s, e):
                found.append((s, e, k, text[s:e], p))
    done = 0
    for mark in _MARK.finditer(text):
        s = mark.start()
        if s < done:
            continue
        while s > done and _TOKEN.match(text, s - 1, s):
            s -= 1
        e = done = _TOKEN.match(text, mark.start()).end()
        while e > s and text[e - 1] in ".!?*&%$#-_/":
            e -= 1
        if e - s < MIN_CHARS or 1 in covered[s:e]:
            continue
        value = text[s:e]
        seed = "secret" if _SECRET.match(value) else None
        p = pattern_of(text, s, e)
        if p or seed:
            found.append((s, e, seed, value, p))
    return spans, found


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document its base spans, and its occurrences as an array."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    item = pa.struct([("s", pa.int64()), ("e", pa.int64()), ("kind", pa.string()), ("value", pa.string()),
                      ("pattern", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, counts, found = [], [], []
            for text in b.column("text").to_pylist():
                base, occ = occurrences(text or "")
                spans.append(span_text(base))
                counts.append([sum(k == kind_ for _, _, k in base) for kind_ in KINDS[:4]])
                found.append([dict(zip(("s", "e", "kind", "value", "pattern"), o)) for o in occ])
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), *(pa.array([c[j] for c in counts], pa.int64()) for j in range(4)),
                 pa.array(spans, pa.string()), pa.array(found, pa.list_(item))],
                names=["id", "n_email", "n_ip", "n_card", "n_phone", "base", "found"])

    return src.mapInArrow(run, f"id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
                               "base string, found array<struct<s:bigint,e:bigint,kind:string,value:string,"
                               "pattern:string>>")


def score_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, confidence, known) from (pattern, value, kind) rows,
    kind null for instances that are not seeds."""
    edges = materialize(edges.distinct(), "edges")
    size = edges.select("pattern", "value").distinct().groupBy("pattern").agg(F.count("*").alias("n"))
    instances = edges.filter("kind is not null").select("value", "kind", F.lit(1.0).alias("conf")).distinct()
    seeds = instances
    patterns = None
    for i in range(rounds):
        links = edges.select("pattern", "value").distinct().join(instances, "value")
        scored = (links.groupBy("pattern", "kind").agg(F.sum("conf").alias("mass"), F.count("*").alias("known"))
                  .join(size, "pattern")
                  .select("pattern", "kind", (F.col("mass") / (F.col("n") + PRIOR)).alias("confidence"), "known"))
        scored = materialize(scored, "patterns")
        if patterns is not None:
            drop_scratch(patterns)
        patterns = scored
        if i + 1 < rounds:
            doubt = F.least(F.col("confidence"), F.lit(0.999))
            new = (edges.select("pattern", "value").distinct()
                   .join(patterns.filter(F.col("known") >= MIN_INSTANCES), "pattern")
                   .groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - doubt)))).alias("conf")))
            instances = (new.union(seeds).groupBy("value", "kind").agg(F.max("conf").alias("conf")))
    return patterns


def find_private_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_email, n_ip, n_card, n_phone (base
    entities), ``base``, ``spans`` ("kind:start:end,..." in code points, sorted
    by start, then kind as in KINDS; spans holds the base ones, tokens of the
    well-known secret formats and those the learned patterns add) and
    ``n_discovered``, the spans that only the patterns found.  Candidates of
    under MIN_CHARS characters are left out, and a pattern lies in the CONTEXT
    characters before its token.

    A null or empty text has no spans; documents without an occurrence keep
    their base spans; repeated rows give the same result each; a null id keeps
    its base spans and gets none added; no rows give no rows.
    """
    scan = materialize(_scan(docs, id_col, text_col), "scan")
    # rows of one id are told apart by their spans and occurrences
    items = (scan.filter("id is not null").withColumn("row", F.xxhash64("base", "found"))
             .select("id", "row", F.explode(F.array_distinct("found")).alias("o")).select("id", "row", "o.*").distinct())
    patterns = score_patterns(items.filter("pattern is not null").select("pattern", "value", "kind"))
    good = patterns.filter((F.col("confidence") >= MIN_CONFIDENCE) & (F.col("known") >= MIN_INSTANCES)
                           ).select("pattern", F.col("kind").alias("as"))
    shape = F.lit(False)
    for kind, regex in _SHAPE.items():
        shape = shape | ((F.col("as") == kind) & F.col("value").rlike(regex))
    # every seed stands, and what the trusted patterns find beside them
    seeds = items.filter("kind = 'secret'").select("id", "row", "s", "e", "kind")
    discovered = (items.filter("kind is null").join(good, "pattern").filter(shape)
                  .select("id", "row", "s", "e", F.col("as").alias("kind")).distinct())
    new = discovered.groupBy("id", "row").agg(F.count("*").alias("n"))
    added = seeds.union(discovered)
    added = added.groupBy("id", "row").agg(F.collect_list(F.struct("s", "e", "kind")).alias("added"))
    order = F.element_at(F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))]), F.col("k"))
    out = scan.withColumn("row", F.xxhash64("base", "found")).drop("found").join(added, ["id", "row"], "left") \
        .join(new, ["id", "row"], "left")
    base = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), _parse)
    extra = F.transform(F.coalesce("added", F.expr("array()").cast("array<struct<s:bigint,e:bigint,kind:string>>")),
                        lambda x: F.struct(x.s.alias("s"), _rank(x.kind).alias("k"), x.e.alias("e"),
                                           x.kind.alias("kind")))
    spans = F.transform(F.array_sort(F.array_union(base, extra)),
                        lambda x: F.concat_ws(":", x.kind, x.s.cast("string"), x.e.cast("string")))
    return out.select(F.col("id").alias(id_col), "n_email", "n_ip", "n_card", "n_phone", "base",
                      F.array_join(spans, ",").alias("spans"), F.coalesce("n", F.lit(0)).alias("n_discovered"))


def _rank(kind):
    out = F.lit(len(KINDS))
    for i, k in enumerate(KINDS):
        out = F.when(kind == k, i).otherwise(out)
    return out


def _parse(x):
    part = F.split(x, ":")
    return F.struct(part[1].cast("bigint").alias("s"), _rank(part[0]).alias("k"), part[2].cast("bigint").alias("e"),
                    part[0].alias("kind"))


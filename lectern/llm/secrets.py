"""Secret scan: rule matches and sliding-window character entropy, as SQL functions over whole texts.

A null text is an empty one and holds no secrets. Repeated rows are scanned each on their own. Extra columns are kept; one
named `secrets` gives way to the spans unless another name is asked for. Nothing is shuffled: every row is judged where it
is read, in time nearly linear in its length and its matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import table

# The rule patterns in order of kind. least: shortest allowed length of the group that is measured.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
RULES = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24))
#: A candidate is a run of at least 20 token characters; only a run's start is tried.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
HEX_ALPHABET = "0123456789abcdef"
TOKEN_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: A word of letters: one case, or humps as in names of programs.
WORD = r"(?:[A-Z]{1,19}|[a-z]{1,19}(?:[A-Z][a-z]{2,18})*+|(?:[A-Z][a-z]{1,18})++)"
#: Allow list: digits with separators only (card and phone numbers, dates), ids in UUID form, words joined by - _ or / or by
#: humps. Each stands for a whole stretch of token characters.
ALLOWED = (
    r"^[0-9+/_=-]+$|^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    rf"|^[/_=-]*{WORD}(?:[/_-]+{WORD})+[/_=-]*$|^(?:[a-z]{{1,19}}|[A-Z][a-z]{{2,18}})(?:[A-Z][a-z]{{2,18}})+$"
)
#: A piece between separators that names a documented example. It is allowed, the stretches before and behind it are not.
EXAMPLE = r"(?<![A-Za-z0-9+])[A-Za-z0-9+]*?(?i:example|placeholder|changeme|xxxx)[A-Za-z0-9+]*"
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def bound(value: Column, use) -> Column:
    """use(value), value being computed once however often use names it."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, combine=lambda s, x: s + x) -> Column:
    """What combine makes of 0 and the first 1, 2, ... values of an array of ints: their running sums, unless told otherwise.

    A fold that appends copies what it has, so the array is cut into about as many parts as each part has values: n values
    cost about n * sqrt(n) copied references, some 10^9 for a million.
    """
    empty = F.array().cast("array<int>")

    def part(values: Column, base: Column) -> Column:
        start = F.struct(base.alias("at"), empty.alias("out"))
        return F.aggregate(values, start, lambda s, x: bound(combine(s["at"], x), lambda at: F.struct(at.alias("at"), F.array_append(s["out"], at).alias("out"))))

    def parts(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int")
        cut = bound(width, lambda n: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(v, i * n + 1, n)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
        step = lambda s, x: bound(part(x, s["at"]), lambda r: F.struct(r["at"].alias("at"), F.array_append(s["out"], r["out"]).alias("out")))
        return F.when(F.size(v) == 0, empty).otherwise(F.flatten(F.aggregate(cut, start, step)["out"]))

    return bound(values, parts)


def located(text: Column, pattern: str, kind: str, group: int = 0, least: int = 1) -> Column:
    """Spans of the leftmost non-overlapping matches of pattern, in code points, whose group has at least so many characters.

    Pieces between the matches and the matches themselves alternate, so running lengths give the places.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = matches if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def spans(m: Column) -> Column:
        ends = running(F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), m, lambda a, b: F.length(a) + F.length(b)))
        kept = F.filter(F.arrays_zip(m.alias("value"), measured.alias("measured"), ends.alias("end")), lambda x: F.length(x["measured"]) >= least)
        return F.transform(kept, lambda x: F.struct(F.lit(kind).alias("kind"), (x["end"] - F.length(x["value"])).alias("start"), x["end"].alias("end"), x["value"].alias("value")))

    return bound(matches, spans)


def rule_spans(text: Column) -> list[Column]:
    """Spans of each rule, in order; a rule's places are computed only for texts that can hold it."""
    lower = F.lower(text)
    words = ("password", "passwd", "secret", "token", "apikey", "api_key")
    possible = {
        "assign": F.lit(False),
        "access": text.contains("AKIA"),
        "hex": text.rlike(r"[0-9a-f]{24}"),
    }
    for word in words:
        possible["assign"] = possible["assign"] | lower.contains(word)
    none = F.array().cast(SPAN)
    return [F.when(possible[kind], located(text, pattern, kind, group, least)).otherwise(none) for kind, pattern, group, least in RULES]


def window_entropy(value: Column, alphabet: str, window: int) -> Column:
    """Largest Shannon entropy, in bits, of any window of that many characters of value.

    The window slides by one: the count of the character that leaves falls by one, that of the one that enters rises by
    one, and the sum of c * log2(c) over all counts changes by those two terms alone. Counts are fields of a few bits in
    long numbers, so a step changes two fields and copies a handful of numbers. Shorter values count as one window.
    """
    bits = window.bit_length()
    per = 62 // bits
    term = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    unit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), ((p - 1) % per) * bits)
    word = lambda p: F.floor((p - 1) / per).cast("int")
    count = lambda words, p: F.call_function("shiftright", F.get(words, word(p)), ((p - 1) % per) * bits).bitwiseAND(F.lit((1 << bits) - 1))
    words = F.array_repeat(F.lit(0).cast("long"), -(-len(alphabet) // per))
    start = F.struct(words.alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))

    def step(places: Column, state: Column, i: Column) -> Column:
        width = F.least(F.lit(window), F.size(places))
        enters, leaves = F.element_at(places, i), F.when(i > width, F.get(places, i - width - 1)).otherwise(F.lit(0))
        some = F.greatest(leaves, F.lit(1))
        change = lambda w, k: w + F.when(k == word(enters), unit(enters)).otherwise(0) - F.when((leaves > 0) & (k == word(some)), unit(some)).otherwise(0)
        same = enters == leaves
        counts = F.when(same, state["counts"]).otherwise(F.transform(state["counts"], change))
        came, went = count(state["counts"], enters), count(state["counts"], some)
        gained = F.when(same, 0.0).otherwise(term(came + 1) - term(came))
        lost = F.when(same | (leaves == 0), 0.0).otherwise(term(went) - term(went - 1))
        total = state["total"] + gained - lost
        entropy = F.when(i >= width, F.log2(width.cast("double")) - total / width).otherwise(F.lit(0.0))
        return F.struct(counts.alias("counts"), total.alias("total"), F.greatest(state["best"], entropy).alias("best"))

    # the characters' places are bound once a value, so that a long run costs no search from its start for each character
    places = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(alphabet), c))
    return bound(places, lambda p: F.aggregate(F.sequence(F.lit(1), F.size(p)), start, lambda state, i: step(p, state, i))["best"])


def beside_examples(span: Column, least: int = 20) -> Column:
    """The stretches of a run between its pieces that name an example, without separators in front, if they are long enough."""

    def between(named: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(named, lambda x: x["end"]))
        ends = F.array_append(F.transform(named, lambda x: x["start"]), F.length(span["value"]))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def trimmed(x: Column) -> Column:
        value = F.substring(span["value"], x["a"] + 1, x["b"] - x["a"])
        short = F.regexp_replace(value, "^[/_=-]+", "")
        start = span["start"] + x["b"] - F.length(short)
        return F.struct(span["kind"].alias("kind"), start.alias("start"), (start + F.length(short)).alias("end"), short.alias("value"))

    return F.filter(F.transform(bound(located(span["value"], EXAMPLE, "example"), between), trimmed), lambda s: F.length(s["value"]) >= least)


def entropy_spans(text: Column, window: int = 20, hex_bits: float = 2.8, token_bits: float = 3.8, letter_bits: float = 3.9) -> Column:
    """Spans of candidate strings with a window of high entropy for their character class, without those on the allow list.

    Classes: hexadecimal digits of one case, letters of one case (a higher bound, as long words have many letters too), others.
    """
    pieces = lambda s: F.when(s["value"].rlike(EXAMPLE), beside_examples(s)).otherwise(F.array(s))
    found = F.filter(F.flatten(F.transform(located(text, CANDIDATE, "entropy"), pieces)), lambda s: ~s["value"].rlike(ALLOWED))
    plain = lambda s: s["value"].rlike(r"^[0-9a-f]+$|^[0-9A-F]+$")
    least = lambda s: F.when(s["value"].rlike(r"^[a-z]+$|^[A-Z]+$"), letter_bits).otherwise(token_bits)
    high = lambda s: F.when(plain(s), window_entropy(F.lower(s["value"]), HEX_ALPHABET, window) >= hex_bits).otherwise(
        window_entropy(s["value"], TOKEN_ALPHABET, window) >= least(s)
    )
    return F.when(text.rlike(CANDIDATE), F.filter(found, high)).otherwise(F.array().cast(SPAN))


def sorted_below(values: Column, x: Column, equal: bool) -> Column:
    """How many of an ascending array of ints are below x, or up to x, by halving."""
    steps = F.array(*[F.lit(1 << i) for i in range(29, -1, -1)])

    def walk(at: Column, step: Column) -> Column:
        here = F.get(values, at + step - 1)
        return F.when((at + step <= F.size(values)) & ((here <= x) if equal else (here < x)), at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), walk)


def not_covered(dense: Column, ruled: list[Column]) -> Column:
    """The spans of dense that the spans of the rules together do not cover wholly.

    Each rule's spans stand in order and do not overlap, so those that touch a span of dense are neighbours, found by
    halving; all together they are about as many as there are spans.
    """
    places = F.struct(*[F.transform(r, lambda x: x["start"]).alias(f"s{i}") for i, r in enumerate(ruled)], *[F.transform(r, lambda x: x["end"]).alias(f"e{i}") for i, r in enumerate(ruled)])

    def touching(p: Column, e: Column) -> Column:
        parts = []
        for i in range(len(ruled)):
            low, high = sorted_below(p[f"e{i}"], e["start"], True), sorted_below(p[f"s{i}"], e["end"], False)
            pairs = F.zip_with(F.slice(p[f"s{i}"], low + 1, F.greatest(high - low, F.lit(0))), F.slice(p[f"e{i}"], low + 1, F.greatest(high - low, F.lit(0))), lambda a, b: F.struct(a.alias("start"), b.alias("end")))
            parts.append(F.when(F.size(p[f"s{i}"]) > 0, pairs).otherwise(F.array().cast("array<struct<start:int,end:int>>")))
        return F.array_sort(F.concat(*parts))

    reach = lambda p, e: F.aggregate(touching(p, e), e["start"], lambda at, r: F.when(r["start"] <= at, F.greatest(at, r["end"])).otherwise(at))
    return bound(places, lambda p: F.filter(dense, lambda e: reach(p, e) < e["end"]))


def scan_secrets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, hex_bits: float = 2.8, token_bits: float = 3.8, letter_bits: float = 3.9, name: str = "secrets") -> DataFrame:
    """All columns of documents and, under a name, spans of rules and of high-entropy strings, by start, then kind in order.

    An entropy span that rule spans cover wholly says nothing new and is left out. Places are code points, ends exclusive.
    """
    row, kinds = F.struct(*[F.col(f"`{c}`") for c in documents.columns]), [kind for kind, *_ in RULES]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # each list is a column of its own, used more than once below: Spark then computes it once a row
    ruled = [r.alias(kind) for r, kind in zip(rule_spans(text), kinds, strict=True)]
    found = documents.select(row.alias("row"), *ruled, entropy_spans(text, window, hex_bits, token_bits, letter_bits).alias("entropy"))
    lists = [F.col(kind) for kind in kinds]
    some = F.size("entropy") > 0
    for one in lists:
        some = some | (F.size(one) > 0)
    order = F.array(*[F.lit(k) for k in (*kinds, "entropy")])
    keyed = F.transform(
        F.concat(*lists, F.when(F.size("entropy") > 0, not_covered(F.col("entropy"), lists)).otherwise(F.col("entropy"))),
        lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).cast("int").alias("place"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    none = F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")
    judged = found.select("row", F.when(some, F.array_sort(keyed)).otherwise(none).alias("spans"))
    return judged.select(*[F.col("row").getField(c).alias(c) for c in documents.columns if c != name], F.col("spans").alias(name))


def redacted(text: Column, spans: Column, mark: str = "[secret]", chunk: int = 1024) -> Column:
    """text with each stretch of overlapping spans, sorted by start, replaced by a mark.

    Places count code points, and reaching one in a text means walking to it; so the text is cut into chunks once, and the
    pieces between stretches are put together from these.
    """

    def piece(chunks: Column, low: Column, high: Column) -> Column:
        first, last = F.floor(low / chunk).cast("int"), F.floor((high - 1) / chunk).cast("int")
        one = F.substring(F.get(chunks, first), low % chunk + 1, high - low)
        more = F.concat(
            F.substring(F.get(chunks, first), low % chunk + 1, F.lit(chunk)),
            F.array_join(F.slice(chunks, first + 2, last - first - 1), ""),
            F.substring(F.get(chunks, last), F.lit(1), (high - 1) % chunk + 1),
        )
        return F.when(low >= high, "").when(first == last, one).otherwise(more)

    def cut(parts: Column) -> Column:
        starts, reach, chunks = parts["starts"], parts["reach"], parts["chunks"]
        begins = F.filter(F.sequence(F.lit(0), F.size(starts) - 1), lambda k: (k == 0) | (F.get(starts, k) >= F.get(reach, k - 1)))
        ends = lambda b, i: F.when(i + 1 < F.size(b), F.get(reach, F.get(b, i + 1) - 1)).otherwise(F.element_at(reach, -1))
        between = lambda b: F.transform(b, lambda k, i: piece(chunks, F.when(i == 0, 0).otherwise(ends(b, i - 1)), F.get(starts, k)))
        return F.array_join(F.array_append(bound(begins, between), piece(chunks, F.element_at(reach, -1), parts["length"])), mark)

    parts = F.struct(
        F.transform(spans, lambda s: s["start"]).alias("starts"), running(F.transform(spans, lambda s: s["end"]), F.greatest).alias("reach"),
        F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % chunk), F.lit(0)).alias("chunks"), F.length(text).alias("length"),
    )
    return F.when(F.size(spans) == 0, text).otherwise(bound(parts, cut))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] != "entropy")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"),
    )


QUERIES = {"op10_secret_scan": op10_secret_scan}

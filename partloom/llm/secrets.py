"""Secret scans: patterns with positions, and a battery of randomness tests under false-discovery control.

All of it is built-in functions.  Spark has no function for the places of matches, but a pattern's matches and the
gaps between them (what ``split`` leaves) tile the text, so places are running sums of their lengths.

The battery looks at every token of ``MIN_TOKEN`` or more characters of the usual alphabets that no pattern span overlaps.  It infers the encoding from the characters that occur
(hex, base32, base64, or letters of one or both cases with or without digits) and holds the token against a uniform alphabet of that encoding:

* chi-squared uniformity of the characters (pairs of equal characters) and of their classes (digits, capitals, small letters, signs),
* runs of classes (language switches class too seldom) and of vowels and others (language alternates too often),
* serial correlation of neighbouring characters.

Each statistic has mean 0 and spread 1 for random strings, falls for language, and is nearly independent of the others, so their sum over its spread is a normal score of randomness: its p-values under the random null are uniform.
A token is reported if that null isn't rejected at ``ALPHA`` and if the other null, language, is: by Benjamini and Hochberg's rule at ``FDR``, each stratum of encoding and length by itself, as long tokens tell more and are fewer.
Under language the sum falls with the length; ``LANGUAGE`` holds its mean and spread for identifiers, paths, joined words and numbers, by encoding, the most random-looking of these kinds each.  The corpus enters only as a table of counts of
stratum by p-value bin, some thousand rows at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import let, settle, text_of

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_TOKEN = 16
TOKEN = rf"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}"
#: By encoding, named by the size of its alphabet: characters of each class in it (digits, capitals, small letters, signs; the encodings of one case count letters as capitals) and vowels.
ALPHABETS = {16: ((10, 6, 0, 0), 2), 26: ((0, 26, 0, 0), 5), 32: ((6, 26, 0, 0), 5), 36: ((10, 26, 0, 0), 5), 52: ((0, 26, 26, 0), 10), 62: ((10, 26, 26, 0), 10), 64: ((10, 26, 26, 2), 10)}
#: Sum of the statistics for language: mean at length 0, by character, spread at length 0, by character.
LANGUAGE = {16: (-3.1, -0.216, 1.8, 0.0), 26: (-0.85, -0.16, 1.85, 0.02), 32: (-1.1, -0.316, 1.9, 0.016), 36: (1.5, -0.45, 1.65, 0.02), 52: (-3.4, -0.303, 2.4, 0.013), 62: (-2.0, -0.363, 2.45, 0.027), 64: (-1.8, -0.438, 2.2, 0.02)}
#: Spread of the sum for random strings: of five statistics, and of the three that an alphabet of one class has.
SPREAD = {26: 1.7}
FIVE = 2.35
STRATA = (16, 20, 24, 28, 32, 40, 48, 64, 96)
ALPHA = 0.01
ALPHA_SCORE = -2.326
FDR = 0.01
BINS = 64
SPAN_BLOCK = 256


def places(text: Column, pattern: str, kind: str, keep=None, group: int | None = None) -> Column:
    """Spans of the leftmost non-overlapping matches: array of (s, k, e), code points, end exclusive.

    ``keep`` filters by the text of ``group`` (or of the match) after matching, so that failing matches still use up their place.
    """
    k = KINDS.index(kind)

    def tile(found: Column, gaps: Column, parts: Column) -> Column:
        n = F.size(found)

        def step(acc: Column, i: Column) -> Column:
            s = acc["at"] + F.length(F.get(gaps, i))
            e = s + F.length(F.get(found, i))
            one = F.struct(s.alias("s"), F.lit(k).alias("k"), e.alias("e"), F.get(parts, i).alias("p"))
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        # Appending copies what has gathered, so matches gather in blocks with places of their own, and the blocks are moved to theirs.
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,k:int,e:int,p:string>>").alias("out"))
        block = lambda b: F.aggregate(F.sequence(b * SPAN_BLOCK, F.least((b + 1) * SPAN_BLOCK, n) - 1), zero, step)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / SPAN_BLOCK).cast("int")), block)

        def moved(blocks: Column) -> Column:
            start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
            before = F.aggregate(blocks, start, lambda a, x: F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
            shift = lambda x, o: F.transform(x["out"], lambda y: F.struct((y["s"] + o).alias("s"), y["k"].alias("k"), (y["e"] + o).alias("e"), y["p"].alias("p")))
            return F.flatten(F.zip_with(blocks, before, shift))

        return let(blocks, moved)

    find = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    spans = let(find(0), lambda found: let(F.split(text, pattern, -1), lambda gaps: let(find(group) if group else found, lambda parts: tile(found, gaps, parts))))
    none = F.array().cast("array<struct<s:int,k:int,e:int,p:string>>")
    spans = F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(none)
    return F.filter(spans, keep) if keep is not None else spans


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0 (Abramowitz and Stegun 7.1.26, error below 2e-7)."""
    t = 1 / (1 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal law."""
    half = 0.5 * erfc(F.abs(z) / F.lit(2**0.5))
    return F.when(z >= 0, half).otherwise(1 - half)


def _by(encoding: Column, values: dict) -> Column:
    """The value of an encoding."""
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(encoding == k, F.lit(float(v))).otherwise(out)
    return out


def _switch_law(shares: list[float]) -> tuple[float, float]:
    """Chance that two neighbours of a random string differ in class, and by how much that of two such switches in a row is above its square."""
    two, three = sum(p * p for p in shares), sum(p**3 for p in shares)
    return 1 - two, 1 - 2 * two + three - (1 - two) ** 2


def battery(token: Column) -> Column:
    """struct(encoding, n, z_even, z_classes, z_runs, z_vowels, z_serial, total, z): z is standard normal for random strings, and far below 0 for language. Padding doesn't count."""

    def of(chars: Column, t: Column) -> Column:
        n = F.size(chars).cast("double")
        like = lambda p: F.rlike(t, F.lit(p))
        encoding = F.when(like("^(?:[0-9a-f]+|[0-9A-F]+)$"), 16).when(like("^(?:[a-z]+|[A-Z]+)$"), 26).when(like("^[A-Z2-7]+$"), 32).when(like("^(?:[a-z0-9]+|[A-Z0-9]+)$"), 36).when(like("^[A-Za-z]+$"), 52).when(like("^[A-Za-z0-9]+$"), 62).otherwise(64)
        # Pairs of equal characters: the sum of squared counts over sorted characters, run by run.
        squares = F.aggregate(
            F.sort_array(chars), F.struct(F.lit("").alias("c"), F.lit(0.0).alias("m"), F.lit(0.0).alias("q")),
            lambda a, c: F.when(a["c"] == c, F.struct(c.alias("c"), (a["m"] + 1).alias("m"), (a["q"] + 2 * a["m"] + 1).alias("q"))).otherwise(F.struct(c.alias("c"), F.lit(1.0).alias("m"), (a["q"] + 1).alias("q"))),
            lambda a: a["q"],
        )
        code = F.transform(chars, lambda c: F.ascii(c).cast("double"))
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)

        def measured(one_case: Column, code: Column) -> Column:
            kind = F.transform(code, lambda x: F.when(x.between(48, 57), 0).when(x.between(65, 90), 1).when(x.between(97, 122), F.when(one_case, 1).otherwise(2)).otherwise(3))
            vowel = F.transform(chars, lambda c: F.lower(c).isin("a", "e", "i", "o", "u"))
            later = lambda a: F.slice(a, 2, F.size(a) - 1)
            earlier = lambda a: F.slice(a, 1, F.size(a) - 1)
            switches = lambda a: let(a, lambda a: total(F.zip_with(earlier(a), later(a), lambda x, y: F.when(x != y, 1.0).otherwise(0.0))))
            of_kind = lambda k, i: F.size(F.filter(k, lambda x: x == i)).cast("double")
            counts = let(kind, lambda k: F.array(*[of_kind(k, i) for i in range(4)]))
            xy = total(F.zip_with(earlier(code), later(code), lambda x, y: x * y))
            return F.struct(counts.alias("counts"), switches(kind).alias("runs"), switches(vowel).alias("vowels"), total(code).alias("x"), total(F.transform(code, lambda x: x * x)).alias("xx"), xy.alias("xy"), F.get(code, F.lit(0)).alias("a"), F.element_at(code, -1).alias("b"))

        def combine(e: Column, q: Column, m: Column) -> Column:
            pairs, k = n * (n - 1) / 2, e.cast("double")
            z_even = (pairs / k - (q - n) / 2) / F.sqrt(pairs / k * (1 - 1 / k))
            several = e != 26
            # Class counts, by Wilson and Hilferty's normal form of chi-squared.
            share = [{x: c[i] / x for x, (c, _) in ALPHABETS.items()} for i in range(4)]
            chi = sum((F.when(p > 0, (F.get(m["counts"], i) - n * p) * (F.get(m["counts"], i) - n * p) / (n * p)).otherwise(0.0) for i, p in enumerate(_by(e, s) for s in share)), F.lit(0.0))
            freedom = _by(e, {x: max(1, sum(c > 0 for c in cs) - 1) for x, (cs, _) in ALPHABETS.items()})
            z_classes = F.when(several, -(F.pow(chi / freedom, F.lit(1 / 3)) - (1 - 2 / (9 * freedom))) / F.sqrt(2 / (9 * freedom))).otherwise(0.0)

            def switch_score(seen: Column, shares: dict[int, list[float]]) -> Column:
                rate, extra = (_by(e, {x: _switch_law(s)[i] for x, s in shares.items()}) for i in (0, 1))
                spread = (n - 1) * rate * (1 - rate) + 2 * (n - 2) * extra
                return F.when(spread > 0, (seen - (n - 1) * rate) / F.sqrt(spread)).otherwise(0.0)

            z_runs = F.when(several, switch_score(m["runs"], {x: [c / x for c in cs] for x, (cs, _) in ALPHABETS.items()})).otherwise(0.0)
            z_vowels = -switch_score(m["vowels"], {x: [v / x, 1 - v / x] for x, (_, v) in ALPHABETS.items()})
            # Serial correlation, expected at -1 / n; its absolute value has mean 0.798 and spread 0.603 when random.
            x, y, xx, yy, w = m["x"] - m["b"], m["x"] - m["a"], m["xx"] - m["b"] * m["b"], m["xx"] - m["a"] * m["a"], n - 1
            vx, vy = w * xx - x * x, w * yy - y * y
            r = F.when((vx > 0) & (vy > 0), (w * m["xy"] - x * y) / F.sqrt(vx * vy)).otherwise(1.0)
            z_serial = -(F.abs((r + 1 / n) * F.sqrt(n)) - 0.798) / 0.603
            both = z_even + z_classes + z_runs + z_vowels + z_serial
            return F.struct(e.alias("encoding"), n.cast("int").alias("n"), z_even.alias("z_even"), z_classes.alias("z_classes"), z_runs.alias("z_runs"), z_vowels.alias("z_vowels"), z_serial.alias("z_serial"), both.alias("total"), (both / _by(e, {x: SPREAD.get(x, FIVE) for x in ALPHABETS})).alias("z"))

        return let(encoding, lambda e: let(squares, lambda q: let(let(code, lambda c: measured(e.isin(16, 26, 32, 36), c)), lambda m: combine(e, q, m))))

    bare = F.regexp_replace(token, "=+$", "")
    return let(bare, lambda t: let(F.filter(F.split(t, ""), lambda x: x != ""), lambda c: F.when(F.size(c) >= 4, of(c, t))))


def language_score(b: Column) -> Column:
    """Standard normal score of a battery under the language null; large if no language."""
    n = b["n"].cast("double")
    at, slope, spread, widening = (_by(b["encoding"], {k: v[i] for k, v in LANGUAGE.items()}) for i in range(4))
    return (b["total"] - (at + slope * n)) / (spread + widening * n)


def _stratum(b: Column) -> Column:
    """Number of the stratum of encoding and length."""
    length = F.lit(0)
    for i, low in enumerate(STRATA):
        length = F.when(b["n"] >= low, F.lit(i)).otherwise(length)
    return length + len(STRATA) * _by(b["encoding"], {k: i for i, k in enumerate(ALPHABETS)}).cast("int")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """One row per row of ``docs``: id, n_assign, n_access, n_hex, and ``found``, the spans (s, k, e) of all kinds sorted by start, then kind; random spans overlap no other.

    Null text counts as empty; repeated rows give repeated rows; other columns are not read. An empty table gives no rows.
    Each token is held against all pattern spans of its document, so a document of many thousands of both takes time with their product.
    """
    t = text_of(docs, text_col)
    rows = docs.select(docs[id_col].alias(id_col), t.alias("t"))
    assign = places(F.col("t"), ASSIGN, "assign", lambda x: F.length(x["p"]) >= 6, group=2)
    rows = rows.select(id_col, F.concat(assign, places(F.col("t"), ACCESS, "access"), places(F.col("t"), HEX, "hex")).alias("base"), places(F.col("t"), TOKEN, "random").alias("tokens"))
    # Only tokens that no pattern span overlaps are tested.
    free = F.filter("tokens", lambda x: ~F.exists("base", lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])))
    # Tokens that are no random string have p-value 1.
    p = lambda b: F.when(F.coalesce(b["z"] >= ALPHA_SCORE, F.lit(False)), upper_tail(language_score(b))).otherwise(1.0)
    tested = F.transform(free, lambda x: let(battery(x["p"]), lambda b: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.coalesce(_stratum(b), F.lit(0)).alias("stratum"), F.least(F.lit(BINS - 1), F.floor(-F.log2(F.greatest(p(b), F.lit(1e-19))))).cast("int").alias("bin"))))
    slim = lambda a: F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    rows = settle(rows.select(id_col, slim("base").alias("base"), tested.alias("tested")))
    # Benjamini and Hochberg by stratum over the binned p-values: the loosest bin whose upper end is within fdr * rank / count.
    counts = rows.select(F.explode("tested").alias("x")).groupBy("x.stratum", "x.bin").count().collect()  # at most strata x bins rows
    bounds = []
    for stratum in range(len(STRATA) * len(ALPHABETS)):
        by_bin = {r["bin"]: r["count"] for r in counts if r["stratum"] == stratum}
        total, rank, bound = sum(by_bin.values()), 0, BINS
        for b in sorted(by_bin, reverse=True):
            rank += by_bin[b]
            if 2.0**-b <= fdr * rank / total:
                bound = b
        bounds.append(bound)
    limit = F.array(*[F.lit(b) for b in bounds])
    random = F.filter("tested", lambda x: (x["bin"] > 0) & (x["bin"] >= F.get(limit, x["stratum"])))
    found = F.array_sort(F.concat("base", slim(random)))
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == KINDS.index(k))).cast("long")
    return rows.select(id_col, n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.array_sort("base").alias("base"), found.alias("found"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined, in the array's order."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")

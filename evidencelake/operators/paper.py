"""Manuscript tables: one row per distinct contribution of a paper, with an audit of what was merged.

A spec names each output column's sources, mode and limits. Rows are dealt by paper once; a
contribution's rows become one list, out of which every column is made where it lies, so that only
rows move, never what their cells hold. Distinct cell values are taken apart once and looked up, if
they are few; else each row's are.

Papers with very many rows (told by counts of buckets of papers) don't become lists: their rows are
unpivoted to cells, these joined with the items of distinct values as claims, claims deduplicated by
key with partial aggregates, and grouped by contribution and column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.functions import text as T
from evidencelake.functions import vocab as V
from evidencelake.sources.scratch import kept

#: Values that count as missing in manuscript cells (fixed values).
MISSING = ("", "None", "N/A", "NA", "N\\A", "Not Applicable", "None Specified", "Not Specified", "-")
CELL, NARRATIVE = 180, 5120  # characters
ITEMS, RESULTS = 8, 4  # shown in a limited list
#: Columns whose values tell the contributions of one paper apart, by task (fixed values).
SIGNATURES = {
    "ERS": ("Target of Recommendation", "Recommender System Type", "Recommendation types", "Evaluation"),
    "DESC": ("Task", "Models", "Groups Created", "Cluster Description", "Theoretical Grounding", "Thereotical Model"),
    "PRED": ("Task", "Student Performance Definition", "Target", "Moment of Prediction", "Models", "Assessment Strategy"),
    "KT": ("Student Performance Definition", "Target", "Models", "Novelty of Model", "Flaw of Previous Models", "Assessment Strategy"),
}
CONTRIBUTION = ["paper_id", "signature"]
#: Distinct values of a column, and characters of them, that are looked up rather than taken apart row by row; of a signature, that moves as a number.
KNOWN, KNOWN_CHARS = 20_000, 2_000_000
SIGNED, SIGNED_CHARS = 200_000, 16_000_000
#: Rows to a task that makes lists.
DEALT = 40_000
#: Rows of the usual bucket of papers, and what a bucket has beyond twice that before its papers' rows go as claims.
BUCKET, MANY = 2_000, 20_000


@dataclass(frozen=True)
class Spec:
    """An output column.

    sources: candidate column names; in modes raw and every each of them counts, in the others the first that is there.
    mode: raw (whole cell values), vocab (labels of tokens, or the tokens as they are), every (labels alone, of every source),
    metric (name=value snippets of the raw values, else these).
    most_items: how many are shown before "+N more"; None shows all. counted_as: the column that the audit names.
    instead_of: the column for which this one serves where that one has nothing; elsewhere it isn't audited.
    """

    column: str
    sources: tuple[str, ...]
    mode: str = "raw"
    vocabulary: tuple[tuple[str, tuple[str, ...]], ...] = ()
    most_items: int | None = None
    most_chars: int = NARRATIVE
    counted_as: str = ""
    instead_of: str = ""
    missing: tuple[str, ...] = MISSING

    @property
    def audit_column(self) -> str:
        return self.counted_as or self.column

    @property
    def shown(self) -> int:
        """Items that can matter for what is shown: an item takes three characters at least."""
        return self.most_items if self.most_items is not None else self.most_chars // 3 + 2

    def words(self) -> V.Vocabulary:
        return {k: list(v) for k, v in self.vocabulary}


def detect_column(columns: Iterable[str], candidates: Iterable[str]) -> str | None:
    """The column that is first by the order of the candidates, compared by key."""
    known = {T.plain_key(c): c for c in columns}
    return next((known[k] for c in candidates if (k := T.plain_key(c)) in known), None)


def first_column(columns: Iterable[str], candidates: Iterable[str]) -> str | None:
    """The first column, by the order of the columns, that is a candidate."""
    wanted = {T.plain_key(c) for c in candidates}
    return next((c for c in columns if T.plain_key(c) in wanted), None)


def _sources(columns: list[str], spec: Spec) -> list[str]:
    if spec.mode in ("vocab", "limited"):
        found = [first_column(columns, spec.sources)]
    else:
        found = [first_column(columns, [s]) for s in spec.sources]
    return list(dict.fromkeys(c for c in found if c))


def _few(rows: DataFrame, columns: dict[str, tuple[int, int]]) -> list[str]:
    """The columns that have at most so many distinct values, of so many characters."""
    if not columns:
        return []
    sizes = rows.agg(*(x for c in columns for x in (F.approx_count_distinct(c), F.coalesce(F.avg(F.length(c)), F.lit(0.0))))).first()
    return [c for i, (c, (most, chars)) in enumerate(columns.items()) if sizes[2 * i] <= most and sizes[2 * i] * sizes[2 * i + 1] <= chars]


def contributions(rows: DataFrame, task: str, ordinal: Column, keep: Callable[[DataFrame], DataFrame] = kept) -> DataFrame:
    """rows with paper_id, signature and ordinal: what a paper's row is about, by the fields that tell contributions apart.

    A row without any id is a paper of its own: the task, a colon, and its ordinal. rows are kept as a table once;
    keys of columns with few distinct values are made once a value.
    """
    columns = [c for c in SIGNATURES.get(task, ()) if c in rows.columns]
    held = keep(rows.withColumn("ordinal", ordinal))
    named = {f"signed{i}": c for i, c in enumerate(columns)}
    found = held.withColumns({name: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for name, c in named.items()})
    few = _few(found, dict.fromkeys(named, (KNOWN, KNOWN_CHARS)))
    plain = found
    for name in named:
        key = T.display_key(F.col(name), MISSING).alias(f"{name}key")
        found = found.join(F.broadcast(plain.select(name).distinct().select(name, key)), name) if name in few else found.withColumn(f"{name}key", key)
    ids = [T.blank_to_null(F.col(f"`{c}`").cast("string")) for c in ("source_page_id", "page_id", "id", "source_title") if c in rows.columns]
    signature = F.concat_ws(" | ", *(F.col(f"{name}key") for name in named))  # leaves nulls out
    own = F.coalesce(*ids, F.concat(F.lit(f"{task}:"), F.col("ordinal").cast("string")))
    made = {"paper_id": F.when(own.rlike(r"^[0-9A-Za-z_]+\z"), own).otherwise(T.display(own)), "signature": F.coalesce(T.blank_to_null(signature), F.lit("__paper__"))}
    return found.select(*(F.col(f"`{c}`") for c in held.columns if c not in made), *(c.alias(name) for name, c in made.items()))


def cells_of(rows: DataFrame, specs: list[Spec]) -> DataFrame:
    """paper_id, signature, ordinal, output_column, rank (of the source) and value of every filled source cell."""
    parts = [F.struct(F.lit(spec.column).alias("output_column"), F.lit(rank).alias("rank"), F.col(f"`{c}`").cast("string").alias("value")) for spec in specs for rank, c in enumerate(_sources(rows.columns, spec))]
    return rows.select(*CONTRIBUTION, "ordinal", F.inline(F.array(*parts))).where("value <> ''")


def _items(spec: Spec, value: Column) -> Column:
    """What a cell value holds: structs of item, raw_token and matched."""
    entry = lambda item, raw, matched: F.struct(item.alias("item"), raw.alias("raw_token"), matched.alias("matched"))
    if spec.mode in ("raw", "metric") or not spec.vocabulary:
        return F.array(entry(T.display(value), value, F.lit(True)))
    words = spec.words()

    def labelled(token: Column) -> Column:
        found = F.transform(V.labels_of(token, words), lambda x: entry(x, token, F.lit(True)))
        return found if spec.mode == "every" else F.when(F.size(found) > 0, found).otherwise(F.array(entry(V.unmatched_label(token), token, F.lit(False))))

    return F.flatten(F.transform(V.cell_tokens(value, spec.missing), labelled))


def claims(rows: DataFrame, specs: list[Spec]) -> DataFrame:
    """paper_id, signature, output_column, seq, item, key, raw_token, matched: cell values are taken apart once each."""
    cells = cells_of(rows, specs)
    values = cells.select("output_column", "value").distinct()
    alike: dict[tuple, list[Spec]] = {}
    for s in specs:
        alike.setdefault(("raw", s.missing) if s.mode in ("raw", "metric") or not s.vocabulary else (s.mode == "every", s.vocabulary, s.missing), []).append(s)
    filled = lambda s: F.when(~T.is_missing(T.clean_whitespace(F.col("value")), s.missing), _items(s, F.col("value")))
    items = F.coalesce(*(F.when(F.col("output_column").isin([s.column for s in own]), filled(own[0])) for own in alike.values()))
    found = values.select("output_column", "value", items.alias("items"))
    # outer, as Spark would otherwise test the items of every row, before values are made distinct
    keyed = found.select("output_column", "value", F.posexplode_outer("items").alias("at", "one")).select("output_column", "value", "at", "one.*", T.clean_whitespace(F.col("one.item")).alias("clean"))
    keyed = keyed.where("clean <> ''").select("output_column", "value", "at", F.col("clean").alias("item"), T.token_key(F.col("clean")).alias("key"), "raw_token", "matched")
    return cells.join(keyed, ["output_column", "value"]).select(*CONTRIBUTION, "output_column", F.struct("rank", "ordinal", "at").alias("seq"), "item", "key", "raw_token", "matched")


def cells(found: DataFrame, specs: list[Spec]) -> DataFrame:
    """paper_id, signature, output_column, items (those that can be shown), n_items (distinct), n_chars (of all, joined) and cell."""
    by = [*CONTRIBUTION, "output_column"]
    once = found.groupBy(*by, "key").agg(F.min(F.struct("seq", "item")).alias("first"))
    per_spec = lambda f: F.element_at(F.create_map(*(x for s in specs for x in (F.lit(s.column), F.lit(f(s))))), F.col("output_column"))
    placed = once.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("first.seq")))
    shown = F.array_sort(F.collect_list(F.when(F.col("k") <= per_spec(lambda s: s.shown), F.col("first"))))
    grouped = placed.groupBy(*by).agg(shown.alias("held"), F.count(F.lit(1)).alias("n_items"), (F.sum(F.length("first.item")) + 2 * (F.count(F.lit(1)) - 1)).alias("n_chars"))
    listed = grouped.withColumn("items", F.transform("held", lambda x: x["item"])).drop("held")
    most, limit = per_spec(lambda s: s.most_items if s.most_items is not None else 1 << 30), per_spec(lambda s: s.most_chars)
    return listed.withColumn("cell", T.shorten(T.limited(F.col("items"), F.col("n_items"), most), limit, cleaned=True))


def _metrics(parts: DataFrame, specs: list[Spec]) -> DataFrame:
    """parts with snippets: those of a metric column's cell, which then are what it shows; null elsewhere."""
    kinds = [s for s in specs if s.mode == "metric"]
    own = F.col("output_column")
    out = parts.where(~own.isin([s.column for s in kinds])) if kinds else parts
    out = out.withColumn("snippets", F.lit(None).cast("array<string>"))
    for s in kinds:
        found = T.dedupe(T.metric_snippets(F.col("cell"), {k: v[0] for k, v in s.vocabulary}))
        mine = parts.where(own == s.column).select("*", F.explode(F.array(found)).alias("snippets"))  # generated, so computed once
        limited = T.shorten(T.limited(F.slice("snippets", 1, RESULTS), F.size("snippets"), RESULTS), s.most_chars, cleaned=True)
        out = out.unionByName(mine.withColumn("cell", F.when(F.size("snippets") > 0, limited).otherwise(F.col("cell"))))
    return out


def _claimed_table(rows: DataFrame, specs: list[Spec]) -> DataFrame:
    """paper_table out of claims."""
    names = [s.column for s in specs]
    parts = _metrics(cells(claims(rows, specs), specs), specs)
    wide = parts.groupBy(*CONTRIBUTION).pivot("output_column", names).agg(F.first("cell"))
    return rows.select(*CONTRIBUTION).distinct().join(wide, CONTRIBUTION, "left").na.fill("", names)


def _used(found: DataFrame, specs: list[Spec]) -> DataFrame:
    """Claims without those of columns that serve instead of one that has claims itself."""
    for s in specs:
        if s.instead_of:
            there = found.where(F.col("output_column") == s.instead_of).select(*CONTRIBUTION).distinct().withColumn("output_column", F.lit(s.column))
            found = found.join(there, [*CONTRIBUTION, "output_column"], "left_anti")
    return found


def _claimed_audit(rows: DataFrame, specs: list[Spec]) -> DataFrame:
    """paper_audit out of claims; they are read several times, so they are kept once as a table."""
    found = kept(_used(claims(rows, specs), specs))
    parts = _metrics(cells(found, specs), specs)
    by_group = rows.groupBy(*CONTRIBUTION).agg(F.count(F.lit(1)).alias("n"))
    several = by_group.groupBy("paper_id").agg(F.count(F.lit(1)).alias("groups")).where("groups > 1")
    row = lambda df, column, action, detail: df.select(*CONTRIBUTION, column.alias("output_column"), F.lit(action).alias("action"), detail.cast("string").alias("detail"))
    own = F.col("output_column")
    named = F.coalesce(F.element_at(F.create_map(*(x for s in specs for x in (F.lit(s.column), F.lit(s.audit_column)))), own), own)
    of = lambda modes: own.isin([s.column for s in specs if s.mode in modes])
    capped = {s.column: s.most_items for s in specs if s.most_items is not None}
    most = F.element_at(F.create_map(*(x for c, n in capped.items() for x in (F.lit(c), F.lit(n)))), own) if capped else F.lit(None).cast("int")
    limit = F.element_at(F.create_map(*(x for s in specs for x in (F.lit(s.column), F.lit(s.most_chars)))), own)
    over = F.col("n_items") > most
    snippets = F.col("snippets")
    return reduce(
        DataFrame.unionByName,
        [
            row(by_group.join(several.select("paper_id"), "paper_id"), F.lit("__row__"), "preserved_distinct_paper_contribution", F.col("signature")),
            row(by_group.where("n > 1"), F.lit("__row__"), "merged_duplicate_extraction_rows", F.col("n")),
            row(found.where(~F.col("matched")), named, "unmatched_token", F.col("raw_token")),
            row(parts.where(over), named, "limited_display_items", F.col("n_items") - most),
            row(parts.where(F.size(snippets) > RESULTS), named, "limited_display_items", F.size(snippets) - RESULTS),
            row(parts.where(most.isNull() & (F.col("n_items") > 1) & of(("raw", "vocab", "metric"))), named, "merged_values", F.col("n_items")),
            row(parts.where(most.isNull() & (F.col("n_chars") > limit)), named, "shortened_cell", F.col("n_chars")),
            row(parts.where(most.isNotNull() & T.is_shortened(T.limited(F.col("items"), F.col("n_items"), most), limit)), named, "shortened_cell", F.length(T.limited(F.col("items"), F.col("n_items"), most))),
        ],
    )


def _kind(spec: Spec) -> tuple:
    """Specs of one kind take a value apart alike."""
    if spec.mode == "metric":
        return "metric", spec.missing, spec.vocabulary, spec.most_items, spec.most_chars
    return ("raw", spec.missing) if spec.mode == "raw" or not spec.vocabulary else (spec.mode == "every", spec.missing, spec.vocabulary)


def _firsts(items: Column) -> Column:
    """Of structs of item and key those that are first of their key, in order."""
    keyed = F.sort_array(F.transform(items, lambda x, i: F.struct(x["key"].alias("key"), i.alias("at"), x["item"].alias("item"))))
    firsts = T.let(keyed, lambda own: F.filter(own, lambda x, i: (i == 0) | (F.get(own, i - 1)["key"] != x["key"])))
    placed = F.sort_array(F.transform(firsts, lambda x: F.struct(x["at"].alias("at"), x["item"].alias("item"), x["key"].alias("key"))))
    return F.when(F.size(items) < 2, items).otherwise(F.transform(placed, lambda x: F.struct(x["item"].alias("item"), x["key"].alias("key"))))


def _shown(texts: Column, joined: Column, spec: Spec) -> Column:
    """A cell of texts, of which joined has all."""
    most = spec.most_items if spec.most_items is not None else 1 << 30
    few = (F.size(texts) <= most) & (F.length(joined) <= spec.most_chars)
    return F.when(few, joined).otherwise(T.shorten(T.limited(F.slice(texts, 1, spec.shown), F.size(texts), most), spec.most_chars, cleaned=True))


def _snippets(cell: Column, spec: Spec) -> Column:
    return T.dedupe(T.metric_snippets(cell, {k: v[0] for k, v in spec.vocabulary}))


def _taken(spec: Spec, value: Column) -> Column:
    """What a cell value holds: the items with their keys, first of each, their texts, these joined, tokens without a label, and a metric's snippets."""
    none = F.array().cast("array<struct<item:string,raw_token:string,matched:boolean>>")
    items = F.coalesce(F.when((value != "") & ~T.is_missing(T.clean_whitespace(value), spec.missing), _items(spec, value)), none)
    clean = F.filter(F.transform(items, lambda x: F.struct(T.clean_whitespace(x["item"]).alias("item"), x["raw_token"].alias("raw_token"), x["matched"].alias("matched"))), lambda x: x["item"] != "")

    def held(found: Column) -> Column:
        firsts = _firsts(F.transform(found, lambda x: F.struct(x["item"].alias("item"), T.token_key(x["item"]).alias("key"))))
        unmatched = F.transform(F.filter(found, lambda x: ~x["matched"]), lambda x: x["raw_token"])
        return T.let(firsts, lambda own: T.let(F.transform(own, lambda x: x["item"]), lambda texts: parts(own, texts, F.array_join(texts, "; "), unmatched)))

    def parts(own: Column, texts: Column, joined: Column, unmatched: Column) -> Column:
        metric = [_snippets(_shown(texts, joined, spec), spec).alias("snippets")] if spec.mode == "metric" else []
        return F.struct(own.alias("items"), texts.alias("texts"), joined.alias("joined"), unmatched.alias("unmatched"), *metric)

    return T.let(clean, held)


def _grouped(rows: DataFrame, specs: list[Spec], n_rows: int) -> DataFrame:
    """paper_id, signature, n (rows), groups (contributions of the paper) and, by the spec's number, c0, c1, ...: texts, joined, unmatched and a metric's snippets.

    Rows move once, by paper; columns are made of lists of a contribution's rows.
    """
    sources = {s.column: _sources(rows.columns, s) for s in specs}
    columns = list(dict.fromkeys(c for found in sources.values() for c in found))
    kinds = list(dict.fromkeys((_kind(s), c) for s in specs for c in sources[s.column]))
    of_kind = {_kind(s): s for s in specs}
    v, k = (lambda c: f"v{columns.index(c)}"), (lambda s, c: f"k{kinds.index((_kind(s), c))}")
    plain = rows.select("paper_id", F.col("signature").alias("signed"), "ordinal", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(v(c)) for c in columns))
    few = _few(plain, {"signed": (SIGNED, SIGNED_CHARS)} | {v(c): (KNOWN, KNOWN_CHARS) for c in columns})
    # such values move as short hashes, several to a long, where these are apart
    pages = F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in few)))
    book = kept(plain.select(pages).distinct()) if few else None
    sizes = {r["column"]: r["n"] for r in book.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()} if few else {}
    bits = {c: 2 * n.bit_length() + 6 for c, n in sizes.items()}
    short = lambda c, value: F.xxhash64(F.lit(c), value).bitwiseAND(F.lit((1 << bits[c]) - 1))
    once = {c: F.count_distinct(F.when(F.col("column") == c, short(c, F.col("value")))) for c in sizes}
    hashes = book.agg(*once.values()).first() if sizes else []
    few = [c for c, n in zip(once, hashes, strict=True) if n == sizes[c]]
    words: list[dict[str, int]] = []  # the places of columns in each
    room = 0
    for c in few:
        if room < bits[c]:
            words.append({})
            room = 62
        room -= bits[c]
        words[-1][c] = room
    dealt = plain
    for i, own in enumerate(words):
        dealt = dealt.withColumn(f"word{i}", reduce(Column.bitwiseOR, (F.shiftleft(short(c, F.col(c)), place) for c, place in own.items())))
    dealt = dealt.drop(*few)
    tasks = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_rows // 2_000)
    dealt = dealt.repartition(max(1, tasks, -(-n_rows // DEALT)), "paper_id")
    dealt = dealt.select("*", *(F.shiftright(f"word{i}", place).bitwiseAND(F.lit((1 << bits[c]) - 1)).alias(f"{c}short") for i, own in enumerate(words) for c, place in own.items()))
    for at, c in enumerate(["signed", *map(v, columns)]):
        taken = {f"k{i}": _taken(of_kind[kind], F.col(c)) for i, (kind, source) in enumerate(kinds) if at and v(source) == c}
        if c in few:
            page = book.where(F.col("column") == c).select(F.col("value").alias(c), short(c, F.col("value")).alias(f"{c}short"))
            dealt = dealt.join(F.broadcast(page.withColumns(taken)), f"{c}short")
        elif taken:
            dealt = dealt.withColumns(taken)
    own = F.sort_array(F.collect_list(F.struct("ordinal", *map(v, columns), *(f"k{i}" for i in range(len(kinds))))))
    lists = dealt.groupBy("paper_id", F.col("signed").alias("signature")).agg(own.alias("own"))
    alike = lambda c: (F.size("own") == 1) | F.forall("own", lambda x: x[v(c)] == F.get("own", F.lit(0))[v(c)])
    lists = lists.select("*", *(alike(c).alias(f"same{v(c)}") for c in columns))

    def column(spec: Spec) -> Column:
        found, metric = [k(spec, c) for c in sources[spec.column]], spec.mode == "metric"
        empty = F.array().cast("array<string>")
        if not found:
            return F.struct(empty.alias("texts"), F.lit("").alias("joined"), empty.alias("unmatched"), *([empty.alias("snippets")] if metric else []))
        first = F.get("own", F.lit(0))
        unmatched = F.concat(*(F.flatten(F.transform("own", lambda x: x[name]["unmatched"])) for name in found))
        unmatched = F.when(F.size("own") == 1, F.concat(*(first[name]["unmatched"] for name in found))).otherwise(unmatched)
        held = lambda texts, joined: [texts.alias("texts"), joined.alias("joined"), unmatched.alias("unmatched")]

        def made(texts: Column) -> Column:
            more = [_snippets(_shown(texts, F.array_join(texts, "; "), spec), spec).alias("snippets")] if metric else []
            return F.struct(*held(texts, F.array_join(texts, "; ")), *more)

        every = F.concat(*(F.flatten(F.transform("own", lambda x: x[name]["items"])) for name in found))
        whole = T.let(F.transform(T.let(every, _firsts), lambda x: x["item"]), made)
        if len(found) > 1:
            texts = F.concat(*(first[name]["texts"] for name in found))
            apart = [(F.size(first[name]["items"]) == 1) for name in found] + [F.get(first[a]["items"], F.lit(0))["key"] != F.get(first[b]["items"], F.lit(0))["key"] for i, a in enumerate(found) for b in found[:i]]
            plain_ = reduce(lambda a, b: a & b, apart, F.size("own") == 1)
            return whole if metric else F.when(plain_, F.struct(*held(texts, F.concat_ws("; ", *(first[name]["joined"] for name in found))))).otherwise(whole)
        one = first[found[0]]
        return F.when(F.col(f"same{v(sources[spec.column][0])}"), F.struct(*held(one["texts"], one["joined"]), *([one["snippets"].alias("snippets")] if metric else []))).otherwise(whole)

    made = lists.select(*CONTRIBUTION, F.size("own").cast("long").alias("n"), *(column(s).alias(f"c{i}") for i, s in enumerate(specs)))
    return made.withColumn("groups", F.count(F.lit(1)).over(Window.partitionBy("paper_id")))


def _cell(at: int, spec: Spec) -> Column:
    own = F.col(f"c{at}")
    shown = _shown(own["texts"], own["joined"], spec)
    if spec.mode != "metric":
        return shown
    n = F.size(own["snippets"])
    return F.when(n > 0, T.shorten(T.limited(F.slice(own["snippets"], 1, RESULTS), n, RESULTS), spec.most_chars, cleaned=True)).otherwise(shown)


def _decisions(specs: list[Spec]) -> Column:
    """The audit's rows of a contribution: structs of output_column, action and detail."""
    entry = lambda test, column, action, detail: F.when(test, F.struct(F.lit(column).alias("output_column"), F.lit(action).alias("action"), detail.cast("string").alias("detail")))
    n = F.col("n")
    rows = [entry((F.col("groups") > 1) & F.col("paper_id").isNotNull(), "__row__", "preserved_distinct_paper_contribution", F.col("signature")), entry(n > 1, "__row__", "merged_duplicate_extraction_rows", n)]
    tokens = []
    for at, s in enumerate(specs):
        own, name = F.col(f"c{at}"), s.audit_column
        used = F.size(F.col(f"c{[x.column for x in specs].index(s.instead_of)}")["texts"]) == 0 if s.instead_of else F.lit(True)
        items, chars = F.size(own["texts"]), F.length(own["joined"])
        if s.mode not in ("raw", "metric") and s.vocabulary:
            listed = F.transform(own["unmatched"], lambda w: F.struct(F.lit(name).alias("output_column"), F.lit("unmatched_token").alias("action"), w.alias("detail")))  # noqa: B023
            tokens.append(F.when(used, listed).otherwise(F.filter(listed, lambda x: F.lit(False))))
        if s.mode == "metric":
            rows.append(entry(used & (F.size(own["snippets"]) > RESULTS), name, "limited_display_items", F.size(own["snippets"]) - RESULTS))
        if s.most_items is None:
            if s.mode in ("raw", "vocab", "metric"):
                rows.append(entry(used & (items > 1), name, "merged_values", items))
            rows.append(entry(used & (chars > s.most_chars), name, "shortened_cell", chars))
        else:
            text = F.when(items <= s.most_items, own["joined"]).otherwise(T.limited(own["texts"], items, s.most_items))
            rows.append(entry(used & (items > s.most_items), name, "limited_display_items", items - s.most_items))
            # cleaning makes three characters of one at most
            rows.append(entry(used & (3 * F.length(text) > s.most_chars) & T.is_shortened(text, s.most_chars), name, "shortened_cell", F.length(text)))
    return F.concat(F.array_compact(F.array(*rows)), *tokens)


def _by_size(rows: DataFrame, n_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """rows of papers with few rows, and of those with many, if any: whole buckets of papers, far beyond the usual."""
    buckets = 1
    while buckets * BUCKET < n_rows:
        buckets *= 2
    bucket = F.pmod(F.xxhash64("paper_id"), F.lit(buckets))
    crowded = kept(rows.groupBy(bucket.alias("bucket")).count().where(F.col("count") > 2 * BUCKET + MANY).select("bucket"))
    if crowded.isEmpty():
        return rows, None
    marked = rows.withColumn("paper_bucket", bucket)
    part = lambda how: marked.join(F.broadcast(crowded), marked["paper_bucket"] == crowded["bucket"], how).drop("paper_bucket")
    return part("left_anti"), part("left_semi")


def _both(rows: DataFrame, specs: list[Spec], keep: Callable[[DataFrame], DataFrame], of_groups: Callable[[DataFrame], DataFrame], of_rows: Callable[[DataFrame, list[Spec]], DataFrame]) -> DataFrame:
    """What is made of grouped rows, and of the rows of crowded papers; only columns that the specs read are kept."""
    sources = dict.fromkeys(c for s in specs for c in _sources(rows.columns, s) if c not in (*CONTRIBUTION, "ordinal"))
    held = keep(rows.select(*CONTRIBUTION, "ordinal", *(F.col(f"`{c}`") for c in sources)))
    n_rows = held.count()
    few, many = _by_size(held, n_rows)
    made = of_groups(_grouped(few, specs, n_rows))
    return made.unionByName(of_rows(many, specs)) if many else made


def as_is(df: DataFrame) -> DataFrame:
    """In place of kept, for rows that are cheap to make again."""
    return df


def paper_table(rows: DataFrame, specs: list[Spec], keep: Callable[[DataFrame], DataFrame] = kept) -> DataFrame:
    """One wide row per contribution (paper_id, signature); columns without a value are empty. rows are read several times, so they are kept once as a table."""
    known = F.col("paper_id").isNotNull() & F.col("signature").isNotNull()
    columns = [F.when(known, _cell(i, s)).otherwise("").alias(s.column) for i, s in enumerate(specs)]
    return _both(rows, specs, keep, lambda groups: groups.select(*CONTRIBUTION, *columns), _claimed_table)


def paper_audit(rows: DataFrame, specs: list[Spec], keep: Callable[[DataFrame], DataFrame] = kept) -> DataFrame:
    """paper_id, signature, output_column, action, detail: the six kinds of decision behind a table. rows are kept as for the table."""
    return _both(rows, specs, keep, lambda groups: groups.select(*CONTRIBUTION, F.inline(_decisions(specs))), _claimed_audit)


def _named(vocabularies: dict[str, V.Vocabulary], name: str) -> tuple[tuple[str, tuple[str, ...]], ...]:
    return tuple((k, tuple(v)) for k, v in vocabularies.get(name, {}).items())


def _shared(v: dict[str, V.Vocabulary]) -> list[Spec]:
    """Columns of every task; vocabularies are the caller's. Names, sources and limits are fixed values."""
    return [
        Spec("Context", ("Context",), "vocab", _named(v, "context"), None, 80),
        Spec("Teaching modality", ("Teaching Method",), "vocab", _named(v, "teaching"), None, 90),
        Spec("Data sources", ("Data sources", "Data source", "Dataset", "Datasets", "Data"), "vocab", _named(v, "data_source"), None, 150),
        Spec("_students", ("Students",), "raw", (), None, 90, "Sample / setting"),
        Spec("_courses", ("Courses",), "raw", (), None, 90, "Sample / setting"),
    ]


def specs_of(task: str, v: dict[str, V.Vocabulary]) -> list[Spec]:
    """The columns of one of the four tables; those that begin with _ are parts of others."""
    algorithms = Spec("Algorithms / models", ("Models",), "vocab", _named(v, "algorithm"), ITEMS, 150)
    assessment = Spec("Assessment strategy", ("Assessment Strategy",), "vocab", _named(v, "assessment"), None, 100)
    results = Spec("Results", ("Performance Metric: Best Model", "Evaluation"), "metric", _named(v, "metric"))
    raw = lambda column, *sources, most=NARRATIVE, part_of="": Spec(column, sources, "raw", (), None, most, part_of)
    own = {
        "ERS": [
            raw("_target", "Target of Recommendation", most=120, part_of="Recommendation target"),
            Spec("Recommender type", ("Recommender System Type",), "vocab", _named(v, "recommender_type"), None, 110),
            raw("Recommendation output", "Recommendation types", most=140),
            Spec("_algorithms", ("Models", "Model", "Algorithm", "Algorithms", "Algorithm Used", "Recommender System Type", "Initialization Method", "Updates to Recommendations", "Preprocessing Details", "Comments"), "every", _named(v, "recommender_algorithm"), ITEMS, 170, "Algorithms / models"),
            replace(algorithms, column="_other_algorithms", sources=("Recommender System Type", "Models", "Algorithm", "Algorithms"), counted_as="Algorithms / models", instead_of="_algorithms"),
            replace(results, sources=("Evaluation",)),
            raw("Limitations", "Limitations"),
            raw("Key implementation note", "Initialization Method", "Updates to Recommendations", "Comments", most=500),
        ],
        "DESC": [
            Spec("Analytic task", ("Task",), "vocab", _named(v, "analytic_task"), None, 100),
            algorithms,
            raw("Results / patterns", "Groups Created", "Cluster Description", "Performance Metric: Best Model", most=400),
            Spec("Theoretical grounding", ("Theoretical Grounding", "Thereotical Model"), "vocab", _named(v, "theory"), None, 120),
            raw("Main result / implication", "Implications", "Comments"),
            raw("Limitations", "Limitations"),
        ],
        "PRED": [
            Spec("Prediction task type", ("Task",), "vocab", _named(v, "analytic_task"), None, 80),
            raw("_definition", "Student Performance Definition", most=110, part_of="Prediction target / timing"),
            raw("_target", "Target", most=100, part_of="Prediction target / timing"),
            raw("_timing", "Moment of Prediction", most=120, part_of="Prediction target / timing"),
            algorithms, assessment, results, raw("Limitations", "Limitations"),
        ],
        "KT": [
            raw("_definition", "Student Performance Definition", most=110, part_of="KT target"),
            raw("_target", "Target", most=100, part_of="KT target"),
            algorithms, assessment, results,
            raw("Prior-model limitations", "Flaw of Previous Models", most=500),
            raw("New contribution", "Novelty of Model", "Comments", most=500),
            raw("Study limitations", "Limitations"),
        ],
    }
    return _shared(v) + own[task]


def features_spec(v: dict[str, V.Vocabulary]) -> Spec:
    """An optional column: feature categories."""
    return Spec("Features", ("Features",), "every", _named(v, "feature"), 7, 170)


def references_by_id(reading: DataFrame, ordinal: Column) -> DataFrame:
    """paper_id and reference (a struct of the reading list's row), under each id a row has; of equal ids the last row counts."""
    ids = [F.when(~T.is_missing(F.col(c).cast("string"), MISSING), F.col(c).cast("string")) for c in ("page_id", "id", "source_page_id") if c in reading.columns]
    rows = reading.select(F.explode(F.array_compact(F.array_distinct(F.array(*ids)))).alias("paper_id"), ordinal.alias("at"), F.struct(*(F.col(f"`{c}`") for c in reading.columns)).alias("reference"))
    return rows.groupBy("paper_id").agg(F.max_by("reference", "at").alias("reference"))


def manuscript(rows: DataFrame, reading: DataFrame, task: str, vocabularies: dict[str, V.Vocabulary], ordinal: Column, reading_ordinal: Column, in_order: bool = False) -> DataFrame:
    """The table of one task: a row per contribution with the shared and the task's own columns.

    in_order sorts it by sort_key. Reading-list rows are looked up by id; a paper without one goes by its rows' first title.
    """
    own = kept(contributions(rows, task, ordinal))
    specs = specs_of(task, vocabularies)
    wide = paper_table(own, specs, as_is)
    title = first_column(rows.columns, ("source_title", "title"))
    said = F.when(~T.is_missing(F.col(f"`{title}`"), MISSING), F.col(f"`{title}`")) if title else F.lit(None).cast("string")
    titles = own.select(*CONTRIBUTION, "ordinal", said.alias("said")).where("said is not null").groupBy(*CONTRIBUTION).agg(F.min_by("said", "ordinal").alias("first_title"))
    table = wide.join(titles, CONTRIBUTION, "left").join(references_by_id(reading, reading_ordinal), "paper_id", "left")
    of = lambda name: T.display(F.col("reference").getField(name).cast("string")) if name in reading.columns else F.lit("")
    shown = T.display(F.coalesce(T.blank_to_null(F.col("reference").getField("title")), "first_title"))
    target = [F.col("_definition"), F.col("_target")] if task in ("PRED", "KT") else []
    made = {
        "ERS": lambda: {"Recommendation target": V.free_text_label(F.col("_target"), vocabularies.get("recommendation_target", {})), "Algorithms / models": F.when(F.col("_algorithms") != "", F.col("_algorithms")).otherwise(F.col("_other_algorithms"))},
        "DESC": dict,
        "PRED": lambda: {"Prediction target / timing": T.combined([V.free_text_label(T.combined(target, 150), vocabularies.get("prediction_target", {})), F.col("_timing")], 190)},
        "KT": lambda: {"KT target": V.free_text_label(T.combined(target, 170), vocabularies.get("kt_target", {}))},
    }[task]()
    plain = {s.column: F.col(f"`{s.column}`") for s in specs if s.column[0] != "_"}
    fixed = {"Study": T.paper_study(of("authors"), of("year"), shown), "Paper title": shown, "Learner representation": of("Learner Representation"), "Work nature": of("Work Nature")}
    every = fixed | plain | {"Sample / setting": T.combined([F.col("_students"), F.col("_courses")], 150)} | made
    made_ = table.select(*CONTRIBUTION, *(c.alias(name) for name, c in every.items()))
    return made_.orderBy(*sort_key(F.col("Study"), F.col("Paper title")), *CONTRIBUTION) if in_order else made_


def sort_key(study: Column, title: Column) -> list[Column]:
    """Year in the study's label, or 9999, then study and title in lower case."""
    return [F.coalesce(T.year_in(study), F.lit(9999)), F.lower(T.clean_whitespace(study)), F.lower(T.clean_whitespace(title))]

"""Merging a snapshot into an archive: joins by key and by row, and the tables they leave.

A row's open segment goes on while its cells stay equal; else it ends with the
version before and a new one begins. Only what begins and ends is written. Keys match null to null and by
occurrence: the k-th row with a key is the k-th row that ever had it, dead or
alive, so a row that comes back has its old identity.

The archive's side of a commit stays where it is: keys and positions are joined in
their buckets, and only the snapshot's rows are dealt out to these. Whether a row's
cells are equal is told by two digests in the narrow table of positions; cells of
the archive are read only where a column went or changed its type, in which case
they are compared as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from palimpsest.functions.cells import as_text, cell_name, family, same_cell
from palimpsest.functions.columns import ArchiveSchema
from palimpsest.functions.keys import NUMBER, number_key
from palimpsest.plans.labels import CHUNK, GAP, first_label, labelled
from palimpsest.plans.ranks import ranked
from palimpsest.snapshots import SnapshotDescriptor
from palimpsest.sources.files import step
from palimpsest.store import ENDED_MOST, ENDED_SHARE, OPEN, Manifest, Part, Store, buckets_for

#: Folders of open segments beyond which they are put into one again, and how many times more rows than buckets are made for.
FOLDERS, GROWTH = 64, 8


@dataclass
class Incoming:
    """Rows of a new version: ``rowid``, ``__pos`` and a cell column for each of ``kinds`` (colid to type)."""

    rows: DataFrame
    kinds: dict[int, str]
    keys: DataFrame | None = None
    new_rows: int = 0
    next_key: int = 0
    most_occ: int = 0
    labels: bool = False  # ``__pos`` holds labels
    frame: int | None = None  # the version among whose rows positions count, if that isn't the new one
    batches: dict[str, int] = field(default_factory=dict)


def key_hash() -> Column:
    """What keys are dealt into buckets by. With the occurrence in it, so that the rows of one key don't lie in one bucket."""
    return F.xxhash64("__key", "__occ")


def with_occurrences(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows with ``__occ``, the number of the row among those of its key, and the most rows that have a key (or key hash). Keys of few rows are numbered by a window each; where a key has more than ``CHUNK``, rows are numbered within chunks of places, and the counts of a key in its chunks are added up, so that a key which many rows have is not one task's."""
    hashed = F.xxhash64("__key")
    most = rows.groupBy(hashed.alias("__kh")).count().agg(F.max("count")).first()[0] or 0
    if most <= 1:
        return rows.withColumn("__occ", F.lit(1)), 1
    if most <= CHUNK:  # sorted by the hash first, which costs less than by the key
        nth = F.row_number().over(Window.partitionBy("__kh", "__key").orderBy("__pos"))
        return rows.withColumn("__kh", hashed).withColumn("__occ", nth).drop("__kh"), most
    rows = rows.withColumn("__chunk", F.floor(F.col("__pos") / CHUNK))
    counts = rows.groupBy("__key", "__chunk").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__key").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    local = F.row_number().over(Window.partitionBy("__key", "__chunk").orderBy("__pos"))
    return rows.withColumn("__nth", local).join(counts.hint("merge"), ["__key", "__chunk"]).withColumn("__occ", (F.col("__before") + F.col("__nth")).cast("int")).drop("__chunk", "__nth", "__before"), most


def new_identities(store: Store, fresh: DataFrame, data: str, cells: list[str], placed: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """Rows with new identifiers in key order, the keys to keep, and their number. If they are ``placed``, their positions count them in this order already."""
    if placed:
        new, n = fresh.withColumn("rowid", F.col("__pos") + F.lit(store.manifest.row_counter)), fresh.count()
    else:
        new, n = ranked(fresh, [F.col("__key"), F.col("__pos")], f"{store.path}/{data}/new", "rowid", store.manifest.row_counter)
    return new.select("rowid", "__pos", *cells), new.select("rowid", F.col("__key").alias("key"), F.col("__occ").alias("occ")), n


def matched(store: Store, doc: DataFrame, cells: list[str], keyed: bool, data: str, by_key: bool = False) -> Incoming:
    """Give each row of ``doc`` (``__key``, null for a row that is new whatever it holds, ``__pos``, cells) the identity it has in the archive, or a new one in key order. ``by_key`` says that positions count the rows in key order, those without one last."""
    m = store.manifest
    given, most = with_occurrences(doc if keyed else doc.where("__key is not null"))
    if most > 1:  # read more than once, so numbered once
        given = step(given, f"{store.path}/{data}/numbered")
        if keyed:
            store.drop_steps(data, "document")
    old, fresh, first = None, given, not m.paths["keys"]
    with store.bucketed("keys") as keys:
        if keys is not None:
            keys = keys.select("rowid", F.col("key").alias("__k"), F.col("occ").alias("__o"), F.col("kh").alias("__h"))
            rows = given.withColumn("__kh", key_hash())
            same = (F.col("__kh") == F.col("__h")) & (F.col("__key") == F.col("__k")) & (F.col("__occ") == F.col("__o"))
            rows = rows.join(store.unsent(keys), same, "left").drop("__k", "__o", "__h", "__kh")
            rows = step(rows, f"{store.path}/{data}/matched")
            store.drop_steps(data, "numbered", *(["document"] if keyed else []))
            old = rows.where("rowid is not null").select("rowid", "__pos", *cells)
            fresh = rows.where("rowid is null").drop("rowid")
    out, keys, n = new_identities(store, fresh, data, cells, by_key and first)
    if keyed and first and not by_key:
        store.drop_steps(data, "document", "numbered")
    next_key = m.next_key
    if not keyed:
        top = doc.agg(F.max(F.when(F.col("__key")[0]["kind"] == NUMBER, F.col("__key")[0]["whole"]))).first()[0]
        next_key = max(next_key, (top if top is not None else -1) + 1)
        more, named, count = unnamed(store, doc.where("__key is null"), data, cells, m.row_counter + n, next_key)
        if count:
            out, keys = out.union(more), keys.union(named)
            next_key, n = next_key + count, n + count
    return Incoming(out if old is None else old.union(out), {}, keys, n, next_key, most)


def unnamed(store: Store, rows: DataFrame, data: str, cells: list[str], first: int, next_key: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows without a row index with identifiers from ``first`` on and indexes above all others, their keys, and their number."""
    rows, n = ranked(rows, [F.col("__pos")], f"{store.path}/{data}/unnamed", "rowid", first)
    index = F.col("rowid") - F.lit(first) + F.lit(max(next_key, first))
    return rows.select("rowid", "__pos", *cells), rows.select("rowid", number_key(index).alias("key"), F.lit(1).alias("occ")), n


def last_of_key(rows: DataFrame, cells: list[str]) -> DataFrame:
    """Of the rows of a key the last one. Tasks fold their own rows first, so a key that many rows have is no task's alone."""
    return rows.groupBy("__key").agg(F.max_by(F.struct("__pos", *cells), F.col("__pos")).alias("__v")).select("__key", "__v.*")


def upserted(store: Store, doc: DataFrame, cells: list[str], keyed: bool, data: str) -> Incoming:
    """Rows of ``doc`` as they come into the last version: of equal keys the last row; it takes the place of the first living row of its key, and others of the key end. Keys and rows are looked up in the files of their buckets. All come with labels; a living row keeps its own."""
    m = store.manifest
    top = lambda n: F.lit(m.top_label) + F.shiftleft(n.cast("bigint") + 1, GAP)
    if not keyed:
        rows, keys, n = unnamed(store, doc, data, cells, m.row_counter, m.next_key)
        rows = rows.withColumn("__pos", top(F.col("rowid") - m.row_counter))
        return Incoming(rows, {}, keys, n, max(m.next_key, m.row_counter) + n if n else m.next_key, 1, True, m.frame(m.snapshots.next_version() - 1))
    doc = last_of_key(doc, cells).withColumn("__occ", F.lit(1))
    doc = step(doc, f"{store.path}/{data}/batch")
    if m.most_occ > 1:  # the other rows of a key may lie in any bucket
        keys = store.keys().select("rowid", F.col("key").alias("__k"))
        found = keys.join(doc.select("__key"), F.col("__key") == F.col("__k")).select("rowid", "__key")
    else:
        hashed = doc.select("__key", key_hash().alias("__kh"))
        keys = store.in_buckets("keys", _buckets(store, hashed, "__kh")).select("rowid", F.col("key").alias("__k"), F.col("kh").alias("__h"))
        found = keys.join(hashed, (F.col("__kh") == F.col("__h")) & (F.col("__key") == F.col("__k"))).select("rowid", "__key")
    found = step(found, f"{store.path}/{data}/found")
    places = store.in_buckets("positions", _buckets(store, found, "rowid")).select(F.col("rowid").alias("__row"), "label")
    # a living row of the key before dead ones, then the one that was there first
    at = store.unsent(places).join(found, F.col("__row") == F.col("rowid"), "right").groupBy("__key").agg(
        F.min(F.struct(F.col("label").isNull().alias("dead"), F.col("rowid"), F.col("label"))).alias("__own"), F.collect_list(F.when(F.col("label").isNotNull(), F.col("rowid"))).alias("__living")
    )
    rows = doc.join(at, "__key", "left")
    old = rows.where("__own is not null")
    fresh, named, n = new_identities(store, rows.where("__own is null").drop("__own", "__living"), data, cells)
    after = fresh.union(old.where("__own.dead").select("__own.rowid", "__pos", *cells))
    placed, _ = ranked(after.withColumnRenamed("__pos", "__at"), [F.col("__at")], f"{store.path}/{data}/placed", "__pos", 0)
    out = old.where("not __own.dead").select("__own.rowid", F.col("__own.label").alias("__pos"), *cells).unionByName(placed.withColumn("__pos", top(F.col("__pos"))).drop("__at"))
    out = out.withColumn("__gone", F.lit(False))
    if m.most_occ > 1:
        gone = old.select(F.explode(F.array_except("__living", F.array("__own.rowid"))).alias("rowid"))
        out = out.unionByName(gone.withColumn("__gone", F.lit(True)), allowMissingColumns=True)
    return Incoming(out, {}, named, n, m.next_key, 1, True, m.frame(m.snapshots.next_version() - 1))


def _buckets(store: Store, rows: DataFrame, column: str) -> set[int]:
    """The buckets of rows; no more numbers than there are buckets."""
    return {r[0] for r in rows.select(store.bucket_of(column)).distinct().collect()}


def digests(kinds: dict[int, str], prefix: str = "") -> tuple[Column, Column]:
    """Two numbers that tell a row's cells from all others'; a cell that is null counts as one that isn't there."""
    parts = []
    for colid, kind in sorted(kinds.items()):
        name = cell_name(colid, kind)
        cell = as_text(F.col(prefix + name), kind) if family(kind)[0].startswith("x") else F.col(prefix + name)
        parts += [F.when(cell.isNotNull(), F.lit(name)), cell]
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)


def _joined(store: Store, incoming: Incoming, m: Manifest, cells: dict[str, str], data: str, partial: bool) -> DataFrame:
    """Every row of the new version with what is known of it: ``n_pos``, digests ``n_d1, n_d2``, the old ``o_label, o_from, o_since``, whether its cells ``changed`` (or are new), whether it is ``gone``, and, if changed, the cells. Written once, but for a first version."""
    version = m.snapshots.next_version()
    own = [cell_name(c, k) for c, k in incoming.kinds.items()]
    d1, d2 = digests(incoming.kinds)
    gone = F.col("__gone") if "__gone" in incoming.rows.columns else F.lit(False)
    rows = incoming.rows.select(F.col("rowid").alias("n_rowid"), F.col("__pos").cast("bigint").alias("n_pos"), d1.alias("n_d1"), d2.alias("n_d2"), gone.alias("n_gone"), *[F.col(c).alias(f"n_{c}") for c in own])
    told = set(m.digested) <= set(own)  # no column went: digests of the same cells are compared
    exact = not told and not partial

    def result(df: DataFrame, changed: Column) -> DataFrame:
        kept = [F.when(changed, F.col(f"n_{c}")).cast(cells[c]).alias(c) for c in own]
        return df.select(F.coalesce("n_rowid", "o_rowid").alias("rowid"), "n_pos", "n_d1", "n_d2", "o_label", "o_from", "o_since", changed.alias("changed"), (F.col("n_rowid").isNull() | F.coalesce("n_gone", F.lit(False))).alias("gone"), F.lit(exact).alias("anew"), *kept)

    def written(df: DataFrame) -> DataFrame:
        return step(df, f"{store.path}/{data}/joined")

    olds = {"o_rowid": "rowid", "o_label": "label", "o_from": "from_version", "o_since": "since", "o_d1": "d1", "o_d2": "d2"}
    is_new = F.col("o_rowid").isNull()
    differs = is_new | ~(F.col("n_d1").eqNullSafe(F.col("o_d1")) & F.col("n_d2").eqNullSafe(F.col("o_d2")))
    there = F.col("n_rowid").isNotNull() & ~F.coalesce("n_gone", F.lit(False))
    if partial:
        rows = step(rows, f"{store.path}/{data}/given")
        places = store.in_buckets("positions", _buckets(store, rows, "n_rowid")).select(*[F.col(v).alias(k) for k, v in olds.items()])
        return written(result(rows.join(store.unsent(places), F.col("n_rowid") == F.col("o_rowid"), "left"), there & differs))
    with store.bucketed("positions", m) as places:
        if places is None:
            none = [F.lit(None).cast("bigint" if k not in ("o_from", "o_since") else "int").alias(k) for k in olds]
            return result(rows.select("*", *none), F.lit(True))
        places = places.select(*[F.col(v).alias(k) for k, v in olds.items()])
        joined = places.join(rows, F.col("o_rowid") == F.col("n_rowid"), "full_outer")
        if not exact:
            return written(result(joined, there & differs))
        with store.bucketed("segments", m) as segments:
            same = F.lit(True)
            for colid, kind in incoming.kinds.items():
                same = same & same_cell(colid, kind, cells, "s_", "n_")
            known = [c for c in cells if c in segments.columns]
            segments = segments.select(F.col("rowid").alias("s_rowid"), *[F.col(c).alias(f"s_{c}") for c in known], *[F.lit(None).cast(cells[c]).alias(f"s_{c}") for c in cells if c not in known])
            return written(result(joined.join(store.unsent(segments), F.col("o_rowid") == F.col("s_rowid"), "left"), there & (is_new | ~same)))


def _states(version: int, kept: dict[str, Column | None], ended: Column, begun: Column, since: Column) -> Column:
    """What ends and what begins of a row, as an array by ``state``; ``kept`` has the columns of what begins, ``since`` is the first version of what ends."""

    def struct(state: str, first: Column, last: int, values: bool) -> Column:
        return F.struct(F.lit(state).alias("state"), F.col("rowid"), first.cast("int").alias("from_version"), F.lit(last).alias("to_version"), *[(v if values else F.when(F.lit(False), v)).alias(c) for c, v in kept.items()])

    return F.filter(F.array(F.when(ended, struct("ended", since, version - 1, False)), F.when(begun, struct("open", F.lit(version), OPEN, True))), lambda s: s.isNotNull())


def write_states(store: Store, df: DataFrame, table: str, path: str, buckets: int, dealt: bool = False) -> tuple[dict[str, Part], dict[str, int]]:
    """Write rows by ``state`` in buckets (in which they lie already if ``dealt``); the folders that came to be, and the number of rows in each, with the largest label."""
    seen = Observation()
    states = ("open", "ended", "closed")
    more = [F.max("label").alias("label")] if table == "positions" else []
    (store.write_dealt if dealt else store.write_bucketed)(df, table, path, buckets, True, seen, *[F.count_if(F.col("state") == s).alias(s) for s in states], *more)
    counts = seen.get
    return {s: Part(f"{path}/state={s}", buckets) for s in states if counts[s]}, counts


def at_once(tasks: dict[str, Callable]) -> dict:
    """Results of a few independent Spark jobs that run beside each other."""
    with ThreadPoolExecutor(max(1, len(tasks))) as pool:
        futures = {name: pool.submit(task) for name, task in tasks.items()}
        return {name: f.result() for name, f in futures.items()}


def _settled(store: Store, table: str, m: Manifest, path: str) -> Manifest:
    """The manifest with a table whose open segments are in one folder again, in the manifest's buckets, and the closed ones of since the last time in another. Folders with a cut are written anew, as they hold open rows too."""
    whole = tuple(p for p in m.paths[f"{table}_closed"] if p.cut is None)
    rest = tuple(p for p in m.paths[f"{table}_closed"] if p.cut is not None)
    own = m.replaced(paths=m.paths | {f"{table}_closed": rest})
    rows = store.spans(table, own, buckets=m.buckets).withColumn("state", F.when(F.col("to_version") == OPEN, "open").otherwise("closed"))
    states, counts = write_states(store, rows, table, path, m.buckets, dealt=True)
    paths = {f"{table}_open": (states["open"],) if "open" in states else (), f"{table}_ended": (), f"{table}_closed": (*whole, *((states["closed"],) if "closed" in states else ()))}
    return m.replaced(paths=m.paths | paths, counts=m.counts | {f"{table}_open": counts["open"], f"{table}_ended": 0})


def advance(store: Store, data: str, schema: ArchiveSchema, incoming: Incoming, descriptor: SnapshotDescriptor | None, partial: bool = False) -> Manifest:
    """Write what changes with the next version; the manifest that will publish it. With ``partial`` the rows that aren't among the incoming ones stay."""
    m = store.manifest
    version = m.snapshots.next_version()
    snapshots = m.snapshots.append(version, descriptor)
    cells = m.cells | {cell_name(c, k): family(k)[1] for c, k in incoming.kinds.items()}
    own = {cell_name(c, k) for c, k in incoming.kinds.items()}
    m = m.replaced(cells=cells)
    rows = _joined(store, incoming, m, cells, data, partial)
    if m.paths["positions_open"]:  # the rows are written; of what they came from only the new keys are still needed
        store.drop_steps(data, "document", "numbered", "matched")
    there, lived = ~F.col("gone"), F.col("o_from").isNotNull()
    narrow = rows.select("rowid", "n_pos", "n_d1", "n_d2", "o_label", "o_from", "o_since", "changed", "gone", "anew")
    if incoming.labels:
        placed = narrow.withColumn("label", F.col("n_pos"))
    elif not m.paths["positions_open"]:
        placed = narrow.withColumn("label", first_label(F.col("n_pos")))
    else:
        placed, _ = labelled(narrow.where(there), f"{store.path}/{data}/labels")
        placed = placed.unionByName(narrow.where("gone").withColumn("label", F.lit(None).cast("bigint")))
    moved = there & (~lived | F.col("changed") | F.col("anew") | (F.col("label") != F.col("o_label")))
    place = {"label": F.col("label"), "d1": F.col("n_d1"), "d2": F.col("n_d2"), "since": F.when(F.col("changed"), version).otherwise(F.col("o_since")).cast("int")}
    places = placed.where(moved | (F.col("gone") & lived)).select(F.explode(_states(version, place, lived, moved, F.col("o_from"))).alias("s")).select("s.*")
    lives = F.col("changed") & there
    cell = {c: F.col(c) if c in own else F.lit(None).cast(k) for c, k in cells.items()}
    segments = rows.where(lives | (F.col("gone") & lived)).select(F.explode(_states(version, cell, lived, lives, F.col("o_since"))).alias("s")).select("s.*")
    buckets = m.buckets if m.counts else buckets_for(incoming.new_rows)
    paths, counts, top = dict(m.paths), dict(m.counts), m.top_label
    tasks = {table: lambda table=table, df=df: write_states(store, df, table, f"{data}/{table}", buckets) for table, df in (("segments", segments), ("positions", places))}
    if incoming.keys is not None and incoming.new_rows:
        keys = incoming.keys.select("rowid", "key", "occ", F.xxhash64("key", "occ").alias("kh"), F.lit(version).alias("since"))
        tasks["keys"] = lambda: store.write_bucketed(keys, "keys", f"{data}/keys", buckets)
        paths["keys"] = (*paths["keys"], Part(f"{data}/keys", buckets))
    written = at_once(tasks)
    for table in ("segments", "positions"):
        states, n = written[table]
        for state in ("open", "ended"):
            part = f"{table}_{state}"
            paths[part] = (*paths[part], *((states[state],) if state in states else ()))
            counts[part] = counts.get(part, 0) + n[state]
        top = max(top, n.get("label") or 0)
    digested = own if not partial and not set(m.digested) <= own else own | set(m.digested)
    frames = m.frames | ({version: incoming.frame} if incoming.frame is not None else {})
    after = Manifest(
        schema, snapshots, m.primary_key, m.row_counter + incoming.new_rows, max(m.next_key, incoming.next_key), paths, cells, counts,
        buckets, max(m.most_occ, incoming.most_occ), top, tuple(sorted(digested)), frames, m.batches | incoming.batches,
    )
    return _compact(store, after, data)


def _compact(store: Store, m: Manifest, data: str) -> Manifest:
    """The manifest after what has become too many folders or ended rows, or too many rows for its buckets, is written anew."""
    alive = m.counts["positions_open"] - m.counts["positions_ended"]
    larger = buckets_for(alive)
    grown = larger >= GROWTH * m.buckets
    if grown:
        m = m.replaced(buckets=larger)
    full = [t for t in ("segments", "positions") if grown or m.counts[f"{t}_ended"] > min(ENDED_MOST, ENDED_SHARE * m.counts[f"{t}_open"]) or len(m.paths[f"{t}_open"]) > FOLDERS]
    tasks = {t: lambda t=t, m=m: _settled(store, t, m, f"{data}/{t}-settled") for t in full}
    if grown or len(m.paths["keys"]) > FOLDERS:
        parts = [F.col("rowid"), F.col("key"), F.col("occ"), F.col("kh"), F.col("since")]
        keys, buckets = store.keys(m, since=True).select(*parts), m.buckets
        tasks["keys"] = lambda: store.write_bucketed(keys, "keys", f"{data}/keys-settled", buckets)
    done = at_once(tasks)
    for t in full:
        own = {k: v for k, v in done[t].paths.items() if k.startswith(f"{t}_")}
        m = m.replaced(paths=m.paths | own, counts=m.counts | {k: v for k, v in done[t].counts.items() if k.startswith(f"{t}_")})
    if "keys" in tasks:
        m = m.replaced(paths=m.paths | {"keys": (Part(f"{data}/keys-settled", m.buckets),)})
    return m

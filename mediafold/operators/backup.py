"""Backup planning and execution (J14/J15: G4-G6, D4, D9, F2, C4, C5, B4, B6, B7).

``backup_plan`` is pure DataFrame work with no I/O: it reduces every content id
to one row (:mod:`mediafold.operators.dedupe`), derives its dated destination,
resolves destinations claimed by several ids in the same batch and paths
already taken on disk, and picks an action per id:

``ignored``  not video/audio/image (C4), counted but not copied
``conflict`` members disagree (C6); reported, nothing copied
``keep``     the existing backup is intact and already at the destination
``move``     the existing backup is intact but its planned path changed (B7)
``present``  the destination already holds this content
``copy``     copy one member whose on-disk stat still matches (B6, C5)
``no_destination`` every candidate path up to 256 bytes is taken

Conflict suffixes: a path held by another id gets ``-{hex id}_XXH3``
appended, again and again, until it is free or holds this id (the reference's
loop).  The number of candidates is bounded by the 256-byte limit
(at most ``(256 - len(dest)) // 22``), so candidates are generated up front and
checked with one equi-join: exact, with no cap below the reference's own.

Shuffles: ``group_stats`` on ``id`` (map-side combined), then aggregations and
joins on ``dest``; each joined side is one row per key, so a destination
claimed by a third of all ids is still one partial row per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediafold.functions import paths as P
from mediafold.functions.ids import id_hex
from mediafold.operators import dedupe, filters

SUFFIX_BYTES = 1 + 16 + len(P.SUFFIX_TAG)  # "-" + 16 hex digits + "_XXH3"


def plan_destinations(groups: DataFrame, root: str, tz: str) -> DataFrame:
    """G4 on reduced groups: ``dest0`` = root/mime/yyyy/MM/dd/shortest-name."""
    return groups.withColumn(
        "dest0", P.destination(root, F.col("mimetype"), F.col("timeborn"), F.col("name"), tz))


def backup_plan(files: DataFrame, backups: DataFrame | None, on_disk: DataFrame,
                root: str, tz: str = "Asia/Shanghai", materialize: bool = True) -> DataFrame:
    """One planned action per content id.

    ``files``: the catalog; ``backups``: ``filez`` (one row per id) or None;
    ``on_disk``: ``(path, disk_id)`` of files currently under the backup
    root and their content ids (a fresh listing joined with its hashes).

    The per-id plan feeds three branches (claims per destination, suffix
    candidates, the final choice).  With ``materialize`` it is checkpointed
    once into the session's shared ``spark.checkpoint.dir`` (one row per
    content id, far smaller than the catalog), which cuts the lineage and
    keeps the catalog scan and group reduction from running three times.
    """
    disk = on_disk.select(F.col("path"), F.col("disk_id"))
    if backups is not None:
        # State of each existing backup, resolved per filez row: intact (same id on disk), rotten (other id) or missing.
        # An id without a backup takes no part, so no join key is NULL; the groups then join filez once, by id.
        held = F.col("disk_id")
        state = (F.when(held.isNull(), F.lit("missing")).when(held == F.col("id"), F.lit("ok"))
                 .otherwise(F.lit("rotten")))
        backups = (backups.join(disk, F.col("name") == F.col("path"), "left").withColumn("state", state)
                   .drop("path", "disk_id"))
    groups = dedupe.reduced_groups(files, backups)
    state = F.col("backup_state") if backups is not None else F.lit(None).cast("string")
    plan = plan_destinations(groups.withColumn("backup_state", F.coalesce(state, F.lit("none"))), root, tz)
    if materialize:
        from mediafold.session import checkpoint_dir
        checkpoint_dir(plan.sparkSession)
        plan = plan.checkpoint(eager=True)

    # Only media groups without conflicts compete for destinations.
    active = filters.backup_media() & ~F.col("conflict")

    # F2 + D9: the owner of a plain destination is the id already stored
    # there when it is among the claimants; nobody when a foreign id holds
    # it; otherwise the smallest id.
    d0 = disk.select(F.col("path").alias("dest0"), F.col("disk_id").alias("disk_id0"))
    claims = (plan.where(active).select("dest0", "id").join(d0, "dest0", "left")
              .groupBy("dest0").agg(
                  F.min("id").alias("min_id"),
                  F.max(F.col("id") == F.col("disk_id0")).alias("stored_is_claimant"),
                  F.first("disk_id0", ignorenulls=True).alias("disk_id0")))
    owner = (F.when(F.col("disk_id0").isNull(), F.col("min_id"))
             .when(F.col("stored_is_claimant"), F.col("disk_id0")))
    plan = plan.join(claims.select("dest0", owner.alias("owner"), "disk_id0"), "dest0", "left")
    owns = F.coalesce(F.col("owner") == F.col("id"), F.lit(False))

    # Non-owners walk the suffix chain; first path that is free or holds this id.
    hexed = id_hex(F.col("id"))
    n_max = F.greatest(F.lit(0), F.floor((F.lit(P.MAX_DEST_BYTES) - F.octet_length("dest0")) / SUFFIX_BYTES)
                       .cast("int"))
    movers = plan.where(active & ~owns).select("id", "dest0", hexed.alias("_hex"), n_max.alias("_n"))
    cands = movers.where(F.col("_n") > 0).select(
        "id", "dest0", "_hex", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("k"))
    cands = cands.select("id", "k", F.concat(
        F.col("dest0"), F.expr(f"repeat(concat('-', _hex, '{P.SUFFIX_TAG}'), k)")).alias("path"))
    # Only suffixed paths can be hit; the others need not take part in the join.
    suffixed = disk.where(F.col("path").endswith(P.SUFFIX_TAG))
    chosen = (cands.join(suffixed, "path", "left")
              .where(F.col("disk_id").isNull() | (F.col("disk_id") == F.col("id")))
              .groupBy("id").agg(F.min_by(F.struct("path", "disk_id"), F.col("k")).alias("_c")))
    plan = plan.join(chosen, "id", "left")

    final_dest = F.when(owns, F.col("dest0")).otherwise(F.col("_c.path"))
    final_disk = F.when(owns, F.col("disk_id0")).otherwise(F.col("_c.disk_id"))
    action = (F.when(~filters.backup_media(), F.lit("ignored"))
              .when(F.col("conflict"), F.lit("conflict"))
              .when(final_dest.isNull(), F.lit("no_destination"))
              .when((F.col("backup_state") == "ok") & (final_dest == F.col("backup_name")), F.lit("keep"))
              .when(F.col("backup_state") == "ok", F.lit("move"))
              .when(final_disk == F.col("id"), F.lit("present"))
              .otherwise(F.lit("copy")))
    return plan.select(
        "id", "id_hex", action.alias("action"),
        F.when(~filters.backup_media() | F.col("conflict"), F.lit(None).cast("string"))
        .otherwise(final_dest).alias("dest"),
        "dest0", "backup_name", "backup_state", "base_name", "name", "size", "timemodified",
        "timeborn", "timebornsrc", "mimetype", "mimesubtype", "n_members")


def copy_sources(plan: DataFrame, files: DataFrame, listing: DataFrame,
                 exclude: DataFrame | None = None, actions: tuple[str, ...] = ("copy", "move")) -> DataFrame:
    """For every ``copy`` id (and ``move`` id, whose fallback is a copy), the first member (by name) whose fresh stat
    still equals the catalog, and how many such members exist.

    ``listing`` is a fresh ``(name, hostname, size, timemodified)`` scan;
    ``exclude`` holds ``(id, name, hostname)`` sources that already failed, so
    an executor that retries simply calls this again (every candidate is
    eventually tried, none is capped).  ``min_by``/``count`` combine map-side,
    so a content id with millions of copies never lands in one task as a list.
    """
    key = ["name", "hostname", "size", "timemodified"]
    todo = plan.where(F.col("action").isin(*actions)).select("id", "dest")
    fresh = files.select("id", *key).join(listing.select(*key), key, "left_semi")
    if exclude is not None:
        fresh = fresh.join(exclude.select("id", "name", "hostname"), ["id", "name", "hostname"], "left_anti")
    best = fresh.groupBy("id").agg(
        F.min_by(F.struct("name", "hostname", "size", "timemodified"),
                 F.struct("name", "hostname")).alias("source"),
        F.count(F.lit(1)).alias("n_candidates"))
    return todo.join(best, "id", "left").withColumn(
        "n_candidates", F.coalesce(F.col("n_candidates"), F.lit(0)))


def plan_outcome(plan: DataFrame, files: DataFrame, listing: DataFrame) -> DataFrame:
    """G6 after C5: ``copy`` ids with no member still matching become ``stale``."""
    src = copy_sources(plan, files, listing, actions=("copy",)).select("id", "source", "n_candidates")
    p = plan.join(src, "id", "left")
    outcome = (F.when((F.col("action") == "copy") & (F.coalesce(F.col("n_candidates"), F.lit(0)) == 0),
                      F.lit("stale")).otherwise(F.col("action")))
    return p.select("id", "id_hex", "action", outcome.alias("outcome"), "dest",
                    F.col("source.name").alias("source_name"),
                    F.coalesce(F.col("n_candidates"), F.lit(0)).alias("n_candidates"))


FILEZ_COLUMNS = ["name", "hostname", "id", "size", "timemodified", "timeborn", "timebornsrc", "mimetype", "mimesubtype"]


def filez_rows(done: DataFrame, backups: DataFrame | None) -> DataFrame:
    """``filez`` after a run: one row per id, name = final path.

    ``done`` has the plan columns plus ``path_final`` (NULL where nothing is in place) and ``status``; it is used twice,
    so it must be a stored result, not a pending run.  An existing row is replaced only by a backup that is in place: a
    failed or conflicting id keeps the row it had, and an id that never had one gets none (its status stays in
    ``done``).
    """
    new = done.where(F.col("path_final").isNotNull()).select(
        F.col("path_final").alias("name"), F.lit(None).cast("string").alias("hostname"), "id", "size",
        "timemodified", "timeborn", "timebornsrc", "mimetype", "mimesubtype", "status")
    if backups is None:
        return new
    kept = backups.join(new.select("id"), "id", "left_anti").select(*FILEZ_COLUMNS).withColumn("status", F.lit("ok"))
    return kept.unionByName(new)


EXECUTE_SCHEMA = "id long, dest string, source_name string, source_hostname string, path_final string, status string"


def _execute_partition(batches):
    import os
    import shutil
    import uuid

    import pandas as pd

    from mediafold.sources.listing import content_id

    def holds(path, wanted):
        if not path or not os.path.exists(path):
            return False
        with open(path, "rb") as f:
            return content_id(f)[0] == wanted

    def place(r):
        """(final path, status); safe to run again after a lost task: work that is already done is found done."""
        if holds(r.dest, r.id):
            return r.dest, "moved" if r.action == "move" else "present"
        os.makedirs(os.path.dirname(r.dest), exist_ok=True)
        if r.action == "move" and holds(r.backup_name, r.id) and not os.path.exists(r.dest):
            try:
                os.replace(r.backup_name, r.dest)
                return r.dest, "moved"
            except OSError:
                pass  # go on with a copy
        if not r.source_name:
            return None, "no_source"
        st = os.stat(r.source_name)
        if st.st_size != r.size or (st.st_mtime_ns + 500_000_000) // 1_000_000_000 != r.source_mtime:
            return None, "source_changed"
        if os.path.exists(r.dest):
            return None, "dest_taken"
        # Every attempt writes a file of its own: a second attempt of the task cannot disturb the first.
        temporary = f"{r.dest}-{int(r.id) & 0xFFFFFFFFFFFFFFFF:016x}.{uuid.uuid4().hex}.tmp"
        try:
            shutil.copy2(r.source_name, temporary)       # keeps mode and mtime
            if not holds(temporary, r.id):
                return None, "verify_failed"
            os.replace(temporary, r.dest)
            return r.dest, "copied"
        finally:
            if os.path.exists(temporary):
                os.remove(temporary)

    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            try:
                final, status = place(r)
            except OSError as e:
                final, status = None, f"failed: {e.__class__.__name__}"
            out.append((r.id, r.dest, r.source_name, r.source_hostname, final, status))
        yield pd.DataFrame(out, columns=["id", "dest", "source_name", "source_hostname", "path_final", "status"])


def execute_plan(plan: DataFrame, sources: DataFrame, partitions: int | None = None) -> DataFrame:
    """Carry out ``copy`` and ``move`` actions on shared storage; one source per id.

    ``sources`` is :func:`copy_sources` output.  Each task copies to a temporary name (mode and mtime kept), re-hashes,
    then renames; the destination owner was fixed by the plan, so no two ids write one path.  The result (``id, dest,
    source_name, source_hostname, path_final, status``) is written to shared storage, so it is carried out once.
    """
    from mediafold.sources.listing import TASK_BYTES, _stored
    todo = (plan.where(F.col("action").isin("copy", "move"))
            .join(sources.select("id", F.col("source.name").alias("source_name"),
                                 F.col("source.hostname").alias("source_hostname"),
                                 F.col("source.timemodified").alias("source_mtime")), "id", "left")
            .select("id", "action", "dest", "backup_name", "size", "source_name", "source_hostname", "source_mtime"))
    if partitions is None:
        n, total = todo.agg(F.count("*"), F.sum("size")).first()
        tasks = plan.sparkSession.sparkContext.defaultParallelism
        partitions = max(1, min(n, max(tasks, -(-(total or 0) // TASK_BYTES))))
    return _stored(todo.repartition(partitions).mapInPandas(_execute_partition, EXECUTE_SCHEMA), "executed")


def run_plan(plan: DataFrame, files: DataFrame, listing: DataFrame, partitions: int | None = None) -> DataFrame:
    """Carry out a plan, trying every matching member of an id until one is in place.

    Returns the plan with ``path_final`` and ``status``.  Each round takes the next source of the ids that failed; it ends
    when all are in place or have no source left, so the number of rounds is bounded by the copies of the worst id.
    """
    from mediafold.sources.listing import _stored
    pending, failed, tried = plan.where(F.col("action").isin("copy", "move")), None, []
    while True:
        done = execute_plan(pending, copy_sources(pending, files, listing, exclude=failed), partitions)
        tried.append(done)
        again = done.where("path_final IS NULL AND source_name IS NOT NULL")
        if again.isEmpty():
            break
        used = again.select("id", F.col("source_name").alias("name"), F.col("source_hostname").alias("hostname"))
        failed = used if failed is None else failed.unionByName(used)
        pending = pending.join(again.select("id"), "id", "left_semi")
    results = tried[0].withColumn("_round", F.lit(0))
    for i, t in enumerate(tried[1:], 1):
        results = results.unionByName(t.withColumn("_round", F.lit(i)))
    # What is in place counts; else the last failure that had a source says why.
    best = results.groupBy("id").agg(F.max_by(F.struct("path_final", "status"), F.struct(
        F.col("path_final").isNotNull(), F.col("source_name").isNotNull(), "_round")).alias("r"))
    joined = plan.join(best, "id", "left")
    settled = F.col("action").isin("keep", "present")
    return _stored(joined.withColumn("path_final", F.when(settled, F.col("dest")).otherwise(F.col("r.path_final")))
                   .withColumn("status", F.coalesce(F.col("r.status"), F.col("action"))).drop("r"), "backup")


def backup_job(files: DataFrame, backups: DataFrame | None, on_disk: DataFrame, listing: DataFrame, root: str,
               tz: str = "Asia/Shanghai") -> tuple[DataFrame, DataFrame]:
    """Plan, carry out with retries, and the ``filez`` table after the run: ``(outcome per id, filez rows)``."""
    done = run_plan(backup_plan(files, backups, on_disk, root, tz), files, listing)
    return done, filez_rows(done, backups)

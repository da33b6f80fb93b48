"""DuckDB twins of the registered queries (the correctness oracle).

Each entry is plain SQL over the driver's pre-registered views and computes
the same columns as the Spark query of the same name.  Shared derivations are
SQL fragments mirroring :mod:`mediafold.plans.derive`.
"""

from __future__ import annotations

# -- shared fragments -------------------------------------------------------

# Signed 64-bit id from the first 16 hex digits of md5(text).
def md5_id(expr: str) -> str:
    u = f"CAST(('0x' || substr(md5({expr}), 1, 16)) AS UBIGINT)"
    return (f"CAST(CASE WHEN {u} >= CAST(9223372036854775808 AS UBIGINT) "
            f"THEN CAST({u} AS HUGEINT) - CAST(18446744073709551616 AS HUGEINT) "
            f"ELSE CAST({u} AS HUGEINT) END AS BIGINT)")


def id_hex(expr: str) -> str:
    return f"lower(lpad(printf('%x', {expr}), 16, '0'))"


DOC_FILES = f"""
  SELECT '/srv/' || source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS name,
         source AS hostname,
         {md5_id('text')} AS id,
         CAST(strlen(text) AS BIGINT) AS size,
         CAST(1500000000 + doc_id * 7919 AS BIGINT) AS timemodified,
         CAST(CASE WHEN lang = 'en' THEN 1400000000 + n_chars * 3600
                   ELSE 1400000000 + doc_id * 86400 END AS BIGINT) AS timeborn,
         CASE WHEN lang IN ('en', 'de') THEN 'meta' WHEN lang = 'fr' THEN 'name' ELSE 'stat' END AS timebornsrc,
         CASE lang WHEN 'en' THEN 'image' WHEN 'fr' THEN 'video' WHEN 'de' THEN 'audio' ELSE 'text' END AS mimetype,
         CASE lang WHEN 'en' THEN 'jpeg' WHEN 'fr' THEN 'mp4' WHEN 'de' THEN 'mpeg' ELSE 'plain' END AS mimesubtype
  FROM documents
"""


def group_stats_sql(files_cte: str) -> str:
    return f"""
  SELECT id, count(*) AS n_members, count(DISTINCT basename) AS n_names,
         arg_min({{'name': name, 'hostname': hostname, 'size': size, 'timemodified': timemodified,
                   'timeborn': timeborn, 'timebornsrc': timebornsrc, 'mimetype': mimetype,
                   'mimesubtype': mimesubtype}}, {{'n': name, 'h': hostname}}) AS first,
         min(size) AS min_size, max(size) AS max_size, min(timemodified) AS min_mtime,
         min(timeborn) AS min_birth,
         min(CASE WHEN timebornsrc = 'meta' THEN timeborn END) AS meta_min_birth,
         max(CASE WHEN timebornsrc = 'meta' THEN timeborn END) AS meta_max_birth,
         arg_min(basename, {{'l': strlen(basename), 'n': name}}) AS short_name,
         CAST(sum(size) AS BIGINT) AS total_bytes
  FROM (SELECT *, string_split(name, '/')[-1] AS basename FROM {files_cte})
  GROUP BY id
"""


DUPLICATE_GROUPS = f"""
WITH f AS ({DOC_FILES}), g AS ({group_stats_sql('f')})
SELECT id, {id_hex('id')} AS id_hex, n_members, n_names, false AS has_backup,
       first.name AS base_name, short_name AS name, first.size AS size,
       least(first.timemodified, min_mtime) AS timemodified,
       least(first.timeborn, min_birth) AS timeborn,
       first.timebornsrc AS timebornsrc, first.mimetype AS mimetype, first.mimesubtype AS mimesubtype,
       total_bytes, total_bytes - first.size AS saved_bytes,
       (min_size <> first.size OR max_size <> first.size
        OR coalesce(meta_min_birth <> first.timeborn, false)
        OR coalesce(meta_max_birth <> first.timeborn, false)) AS conflict
FROM g
"""


ORACLE = {
    "duplicate_groups": DUPLICATE_GROUPS,
}


# -- time from a path (H1-H3) -----------------------------------------------

_DT = r"\D\d{4}[\-_]\d{2}[\-_]\d{2}[^\n]{1,4}\d{2}\D\d{2}\D\d{2,}"
_D = r"\D\d{4}[\-_]\d{2}[\-_]\d{2,}"
_DP = r"\D\d{4}/\d{1,2}/?\d*"
_C = r"(202[0-9]|201[0-9]|200[0-9]|[0-1][0-9]{3})(1[0-2]|0[1-9])(3[01]|[0-2][1-9]|[12]0)"


def _unix_sql(y: str, m: str, d: str, extra: str = "") -> str:
    return (f"((date_diff('day', DATE '1970-01-01', make_date(least(greatest({y}, 1), 9999), "
            f"least(greatest({m}, 1), 12), 1)) + ({d}) - 1) * 86400{extra})")


def time_from_path_sql(expr: str, now_year: int) -> str:
    ymax = now_year + 3
    p = f"(CASE WHEN starts_with({expr}, '/') THEN {expr} ELSE '/' || {expr} END)"
    mdt = f"regexp_extract({p}, '{_DT}', 0)"
    md = f"regexp_extract({p}, '{_D}', 0)"
    mdp = f"regexp_extract({p}, '{_DP}', 0)"
    mc = f"regexp_extract({p}, '{_C}', 0)"

    def parts(m):
        lst = f"regexp_extract_all({m}, '\\d{{1,4}}')"
        return lst, [f"CAST({lst}[{i}] AS INTEGER)" for i in range(1, 7)]

    def ok(y, mo, d):
        return f"({y} >= 1990 AND {y} <= {ymax} AND {mo} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND 31)"

    l, (y, mo, d, h, mi, s) = parts(mdt)
    t_dt = (f"CASE WHEN len({l}) = 6 AND {ok(y, mo, d)} AND {h} BETWEEN 0 AND 24 AND {mi} BETWEEN 0 AND 59 "
            f"AND {s} BETWEEN 0 AND 59 THEN {_unix_sql(y, mo, d, f' + {h} * 3600 + {mi} * 60 + {s}')} END")
    l, (y, mo, d, *_) = parts(md)
    t_d = f"CASE WHEN len({l}) = 3 AND {ok(y, mo, d)} THEN {_unix_sql(y, mo, d)} END"
    l, (y, mo, d, *_) = parts(mdp)
    d = f"(CASE WHEN len({l}) = 2 THEN 1 ELSE {d} END)"
    t_dp = f"CASE WHEN len({l}) BETWEEN 2 AND 3 AND {ok(y, mo, d)} THEN {_unix_sql(y, mo, d)} END"
    y, mo, d = (f"CAST(substr({mc}, 1, 4) AS INTEGER)", f"CAST(substr({mc}, 5, 2) AS INTEGER)",
                f"CAST(substr({mc}, 7, 2) AS INTEGER)")
    t_c = f"CASE WHEN {ok(y, mo, d)} THEN {_unix_sql(y, mo, d)} END"
    return (f"CAST(CASE WHEN strlen({expr}) < 6 THEN NULL WHEN {mdt} <> '' THEN {t_dt} "
            f"WHEN {md} <> '' THEN {t_d} WHEN {mdp} <> '' THEN {t_dp} WHEN {mc} <> '' THEN {t_c} END AS BIGINT)")


NOW_YEAR = 2026


def _pad2_sql(e: str) -> str:
    return f"lpad(CAST({e} AS VARCHAR), 2, '0')"


ORDER_FILES = f"""
  SELECT o_orderkey AS file_key,
    CASE
      WHEN o_orderpriority = '1-URGENT' THEN '/media/' || CAST(o_custkey AS VARCHAR) || '/' || strftime(o_orderdate, '%Y')
           || '-' || strftime(o_orderdate, '%m') || '-' || {_pad2_sql('1 + o_orderkey % 31')} || '_'
           || {_pad2_sql('(o_orderkey * 7) % 25')} || '-' || {_pad2_sql('(o_orderkey * 13) % 60')} || '-'
           || {_pad2_sql('(o_custkey * 17) % 61')} || '.mp4'
      WHEN o_orderpriority = '2-HIGH' THEN '/backup/' || strftime(o_orderdate, '%Y') || '_' || strftime(o_orderdate, '%m')
           || '_' || strftime(o_orderdate, '%d') || CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderkey AS VARCHAR) ELSE '' END
           || '/scan' || CAST(o_orderkey AS VARCHAR) || '.png'
      WHEN o_orderpriority = '3-MEDIUM' THEN CASE WHEN o_orderstatus = 'F'
           THEN '/albums/' || strftime(o_orderdate, '%Y') || '/' || CAST(month(o_orderdate) AS VARCHAR) || '/'
                || CAST(day(o_orderdate) AS VARCHAR) || '/p' || CAST(o_orderkey AS VARCHAR) || '.jpg'
           ELSE '/albums/' || strftime(o_orderdate, '%Y') || '/' || CAST(month(o_orderdate) AS VARCHAR)
                || '/x' || CAST(o_orderkey AS VARCHAR) || '.jpg' END
      WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '/dcim/' || CAST(o_custkey AS VARCHAR) || '/VID'
           || CASE WHEN o_orderstatus = 'P' THEN CAST(year(o_orderdate) - 8 AS VARCHAR) ELSE strftime(o_orderdate, '%Y') END
           || strftime(o_orderdate, '%m') || strftime(o_orderdate, '%d') || '.mov'
      ELSE '/inbox/' || strftime(o_orderdate, '%Y') || '-' || strftime(o_orderdate, '%m') || '-' || strftime(o_orderdate, '%d')
           || '/IMG-' || strftime(CAST(o_orderdate AS DATE) - CAST(o_orderkey % 400 AS INTEGER), '%Y%m%d') || '.jpg'
    END AS name,
    CAST(epoch(o_orderdate) AS BIGINT) + ((o_custkey % 7) - 3) * 86400 AS timemodified
  FROM orders
"""


def _birth_sql(name: str, mtime: str) -> tuple[str, str, str, str]:
    t_full = time_from_path_sql(name, NOW_YEAR)
    t_base = time_from_path_sql(f"string_split({name}, '/')[-1]", NOW_YEAR)
    birth = (f"CASE WHEN coalesce(year(to_timestamp({t_base})) > 1980 AND {t_base} < {t_full}, false) "
             f"THEN {t_base} ELSE {t_full} END")
    return t_full, t_base, birth, f"({birth} IS NOT NULL AND {mtime} >= {birth})"


_tf, _tb, _birth, _use = _birth_sql("name", "timemodified")
BIRTH_FROM_NAME = f"""
WITH f AS ({ORDER_FILES})
SELECT file_key, name, timemodified, {_tf} AS name_time, {_tb} AS base_time, {_birth} AS path_time,
       CASE WHEN {_use} THEN {_birth} ELSE timemodified END AS timeborn,
       CASE WHEN {_use} THEN 'name' ELSE 'stat' END AS timebornsrc
FROM f
"""
ORACLE["birth_from_name"] = BIRTH_FROM_NAME


# -- catalog diff / upsert / change log (J12) --------------------------------

ORDERS_LISTING = """
  SELECT '/data/' || o_orderstatus || '/' || CAST(o_orderkey AS VARCHAR) || '.dat' AS name,
         'host' || substr(o_orderpriority, 1, 1) AS hostname,
         CAST(floor(o_totalprice * 100) AS BIGINT) AS size,
         CAST(epoch(o_orderdate) AS BIGINT) AS timemodified
  FROM orders
"""


def _catalog_row(name: str, size: str, mtime: str, host: str) -> str:
    return (f"{name} AS name, {host} AS hostname, {md5_id(f'{name} || {chr(39)}:{chr(39)} || CAST({size} AS VARCHAR)')} AS id, "
            f"{size} AS size, {mtime} AS timemodified, {mtime} AS timeborn, 'stat' AS timebornsrc, "
            f"'application' AS mimetype, 'octet-stream' AS mimesubtype")


_ON = "'/data/' || o_orderstatus || '/' || CAST(o_orderkey AS VARCHAR) || '.dat'"
_OS = ("(CAST(floor(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)")
_OM = ("(CAST(epoch(o_orderdate) AS BIGINT) - CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' "
       "THEN 3600 ELSE 0 END)")
_CN = "'/data/gone/' || CAST(c_custkey AS VARCHAR) || '.dat'"
ORDERS_CATALOG = f"""
  SELECT {_catalog_row(_ON, _OS, _OM, "'host' || substr(o_orderpriority, 1, 1)")} FROM orders WHERE o_orderstatus <> 'O'
  UNION ALL
  SELECT {_catalog_row(_CN, 'CAST(c_custkey * 10 AS BIGINT)', 'CAST(1600000000 + c_custkey AS BIGINT)', "'host1'")}
  FROM customer
"""

CATALOG_DIFF = f"""
WITH l AS ({ORDERS_LISTING}), c AS ({ORDERS_CATALOG})
SELECT coalesce(l.name, c.name) AS name, coalesce(l.hostname, c.hostname) AS hostname,
       CASE WHEN l.name IS NULL THEN 'vanished' WHEN c.name IS NULL THEN 'new'
            WHEN l.size = c.size AND l.timemodified = c.timemodified THEN 'unchanged' ELSE 'changed' END AS status,
       l.size AS size, l.timemodified AS timemodified, c.size AS old_size, c.timemodified AS old_timemodified,
       c.id AS old_id
FROM l FULL OUTER JOIN c ON l.name = c.name AND l.hostname = c.hostname
"""

_NEW_ROWS = f"""
  SELECT name, hostname, {md5_id("name || ':' || CAST(size AS VARCHAR)")} AS id, size, timemodified,
         timemodified AS timeborn, 'stat' AS timebornsrc, 'application' AS mimetype, 'octet-stream' AS mimesubtype
  FROM l WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.name = l.name AND c.hostname = l.hostname
                           AND c.size = l.size AND c.timemodified = l.timemodified)
"""

CATALOG_UPSERT = f"""
WITH l AS ({ORDERS_LISTING}), c AS ({ORDERS_CATALOG}), n AS ({_NEW_ROWS})
SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.name = c.name AND n.hostname = c.hostname)
UNION ALL SELECT * FROM n
"""

CATALOG_HISTORY = f"""
WITH l AS ({ORDERS_LISTING}), c AS ({ORDERS_CATALOG}), n AS ({_NEW_ROWS})
SELECT c.name, c.hostname, c.id AS old_id, c.size AS old_size, c.timemodified AS old_timemodified,
       n.id AS new_id, n.size AS new_size, n.timemodified AS new_timemodified,
       CAST(1767225600 AS BIGINT) AS changed_at
FROM c JOIN n ON c.name = n.name AND c.hostname = n.hostname
"""

ORACLE["catalog_diff"] = CATALOG_DIFF
ORACLE["catalog_upsert"] = CATALOG_UPSERT
ORACLE["catalog_history"] = CATALOG_HISTORY


# -- filters, ids, years --------------------------------------------------------

ORACLE["size_filter"] = """
SELECT doc_id, size FROM (SELECT doc_id, CAST((n_chars - 4) * 1000000 AS BIGINT) AS size FROM documents)
WHERE size > 0 AND size <= 8589934592
"""

ORACLE["content_ids"] = f"""
SELECT doc_id, {md5_id('text')} AS id, substr(md5(text), 1, 16) AS id_hex FROM documents
"""

_YEAR = ("coalesce(CAST(list_filter(regexp_extract_all({e}, '\\d{{4,5}}'), "
         "lambda x: CAST(x AS INTEGER) > 1990 AND CAST(x AS INTEGER) < 2029)[1] AS INTEGER), 0)")
ORACLE["year_in_text"] = f"""
SELECT 'documents' AS source, doc_id AS key, {_YEAR.format(e='text')} AS year FROM documents
UNION ALL
SELECT 'pages' AS source, page_id AS key, {_YEAR.format(e='url')} AS year FROM pages
"""

ORACLE["group_conflicts"] = f"""
WITH f AS ({DOC_FILES}), g AS ({group_stats_sql('f')}),
r AS (
  SELECT id, {id_hex('id')} AS id_hex, n_members, first.name AS base_name, first.size AS size,
         least(first.timeborn, min_birth) AS timeborn,
         (min_size <> first.size OR max_size <> first.size) AS size_conflict,
         (coalesce(meta_min_birth <> first.timeborn, false)
          OR coalesce(meta_max_birth <> first.timeborn, false)) AS birth_conflict
  FROM g)
SELECT * FROM r WHERE size_conflict OR birth_conflict
"""


def _ignore_sql() -> str:
    from mediafold.operators.filters import glob_to_regex
    from mediafold.plans.queries import IGNORE_GLOBS
    vals = ", ".join(f"('{d}', '{glob_to_regex(g)}')" for d, g in IGNORE_GLOBS)
    return f"""
WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages),
pats(dir, regex) AS (VALUES {vals}),
idx AS (SELECT page_id, path, unnest(range(0, len(string_split(path, '/')))) AS i FROM p),
anc AS (SELECT page_id, path,
               CASE WHEN i = 0 THEN '' ELSE array_to_string(string_split(path, '/')[1:i], '/') || '/' END AS dir
        FROM idx),
hit AS (SELECT DISTINCT page_id FROM anc JOIN pats USING (dir)
        WHERE regexp_matches(substr(path, length(dir) + 1), regex)
           OR regexp_matches(string_split(path, '/')[-1], regex))
SELECT p.page_id, p.path, (hit.page_id IS NOT NULL) AS ignored
FROM p LEFT JOIN hit ON p.page_id = hit.page_id
"""


ORACLE["ignore_paths"] = _ignore_sql()


# -- backup plan (J14) ------------------------------------------------------------

def _dest_sql(mime: str, birth: str, bn: str) -> str:
    return (f"regexp_replace('/backup/' || {mime} || '/' || strftime(timezone('Asia/Shanghai', to_timestamp({birth})), "
            f"'%Y/%m/%d') || '/' || {bn}, '/+', '/', 'g')")


_BN = "string_split({0}, '/')[-1]"
BACKUP_INPUTS = f"""
f AS ({DOC_FILES}),
fx AS (SELECT *, {_dest_sql('mimetype', 'timeborn', _BN.format('name'))} AS own_dest FROM f),
b AS (SELECT id, arg_min({{'name': own_dest, 'hostname': hostname, 'size': size, 'timemodified': timemodified,
                          'timeborn': timeborn, 'timebornsrc': timebornsrc, 'mimetype': mimetype,
                          'mimesubtype': mimesubtype}}, name) AS backup
      FROM fx WHERE hostname IN ('src0', 'src1', 'src2', 'src3') GROUP BY id),
disk AS (
  SELECT backup.name AS path, CASE WHEN backup.hostname = 'src1' THEN xor(id, 1) ELSE id END AS disk_id
  FROM b WHERE backup.hostname <> 'src2'
  UNION ALL SELECT own_dest, xor(id, 7) FROM fx WHERE hostname IN ('src5', 'src6')
  UNION ALL SELECT own_dest || '-' || {id_hex('id')} || '_XXH3', xor(id, 9) FROM fx WHERE hostname = 'src6'
  UNION ALL SELECT own_dest, id FROM fx WHERE hostname = 'src7')
"""

BACKUP_PLAN_CTES = f"""
{BACKUP_INPUTS},
g AS ({group_stats_sql('f')}),
r AS (SELECT g.*, b.backup, coalesce(b.backup, g.first) AS base FROM g LEFT JOIN b USING (id)),
red AS (
  SELECT id, {id_hex('id')} AS id_hex, n_members, base.name AS base_name,
         CASE WHEN backup IS NULL OR strlen(short_name) < strlen({_BN.format('base.name')}) THEN short_name
              ELSE {_BN.format('base.name')} END AS name,
         base.size AS size, least(base.timemodified, min_mtime) AS timemodified,
         least(base.timeborn, min_birth) AS timeborn, base.timebornsrc AS timebornsrc,
         base.mimetype AS mimetype, base.mimesubtype AS mimesubtype,
         (min_size <> base.size OR max_size <> base.size OR coalesce(meta_min_birth <> base.timeborn, false)
          OR coalesce(meta_max_birth <> base.timeborn, false)) AS conflict,
         backup.name AS backup_name
  FROM r),
p1 AS (SELECT red.*, {_dest_sql('mimetype', 'timeborn', 'name')} AS dest0 FROM red),
p2 AS (SELECT p1.*, CASE WHEN backup_name IS NULL THEN 'none' WHEN bd.disk_id IS NULL THEN 'missing'
                         WHEN bd.disk_id = p1.id THEN 'ok' ELSE 'rotten' END AS backup_state,
              (coalesce(mimetype IN ('video', 'audio', 'image'), false) AND NOT conflict) AS active
       FROM p1 LEFT JOIN disk bd ON bd.path = p1.backup_name),
claims AS (SELECT a.dest0, min(a.id) AS min_id, bool_or(a.id = d.disk_id) AS stored_is_claimant,
                  min(d.disk_id) AS disk_id0
           FROM p2 a LEFT JOIN disk d ON d.path = a.dest0 WHERE a.active GROUP BY a.dest0),
p3 AS (SELECT p2.*, c.disk_id0,
              coalesce(CASE WHEN c.disk_id0 IS NULL THEN c.min_id WHEN c.stored_is_claimant THEN c.disk_id0 END
                       = p2.id, false) AS owns
       FROM p2 LEFT JOIN claims c USING (dest0)),
movers AS (SELECT id, dest0, id_hex AS h,
                  CAST(greatest(0, floor((256 - strlen(dest0)) / 22)) AS INTEGER) AS n
           FROM p3 WHERE active AND NOT owns),
cands AS (SELECT id, k, dest0 || repeat('-' || h || '_XXH3', k) AS path
          FROM (SELECT id, dest0, h, unnest(range(1, n + 1)) AS k FROM movers WHERE n > 0)),
chosen AS (SELECT c.id, arg_min({{'path': c.path, 'disk_id': d.disk_id}}, c.k) AS ch
           FROM cands c LEFT JOIN disk d ON d.path = c.path
           WHERE d.disk_id IS NULL OR d.disk_id = c.id GROUP BY c.id),
p4 AS (SELECT p3.*, CASE WHEN owns THEN dest0 ELSE ch.path END AS fdest,
              CASE WHEN owns THEN disk_id0 ELSE ch.disk_id END AS fdisk
       FROM p3 LEFT JOIN chosen USING (id)),
plan AS (
  SELECT id, id_hex,
         CASE WHEN NOT coalesce(mimetype IN ('video', 'audio', 'image'), false) THEN 'ignored'
              WHEN conflict THEN 'conflict'
              WHEN fdest IS NULL THEN 'no_destination'
              WHEN backup_state = 'ok' AND fdest = backup_name THEN 'keep'
              WHEN backup_state = 'ok' THEN 'move'
              WHEN fdisk = id THEN 'present'
              ELSE 'copy' END AS action,
         CASE WHEN NOT coalesce(mimetype IN ('video', 'audio', 'image'), false) OR conflict THEN NULL ELSE fdest END AS dest,
         dest0, backup_name, backup_state, base_name, name, size, timemodified, timeborn, timebornsrc,
         mimetype, mimesubtype, n_members
  FROM p4)
"""

ORACLE["backup_plan"] = f"WITH {BACKUP_PLAN_CTES} SELECT * FROM plan"

ORACLE["plan_outcome"] = f"""
WITH {BACKUP_PLAN_CTES},
lst AS (SELECT name, hostname, size + CASE WHEN contains(name, '/es/') THEN 1 ELSE 0 END AS size, timemodified
        FROM f WHERE hostname <> 'src8'),
fresh AS (SELECT f.id, f.name, f.hostname FROM f
          WHERE EXISTS (SELECT 1 FROM lst WHERE lst.name = f.name AND lst.hostname = f.hostname
                        AND lst.size = f.size AND lst.timemodified = f.timemodified)),
best AS (SELECT id, arg_min(name, {{'n': name, 'h': hostname}}) AS source_name, count(*) AS n FROM fresh GROUP BY id)
SELECT p.id, p.id_hex, p.action,
       CASE WHEN p.action = 'copy' AND coalesce(b.n, 0) = 0 THEN 'stale' ELSE p.action END AS outcome,
       p.dest, CASE WHEN p.action = 'copy' THEN b.source_name END AS source_name,
       CASE WHEN p.action = 'copy' THEN coalesce(b.n, 0) ELSE 0 END AS n_candidates
FROM plan p LEFT JOIN best b ON b.id = p.id
"""


_OUTCOME = ORACLE["plan_outcome"].split("SELECT p.id, p.id_hex, p.action,")
ORACLE["filez_upsert"] = f"""
{_OUTCOME[0].rstrip()},
outcome AS (SELECT p.id, p.id_hex, p.action, {_OUTCOME[1]}),
new AS (SELECT p.id_hex, p.id, p.dest AS name, p.size, p.timemodified, p.timeborn, p.timebornsrc, p.mimetype,
               p.mimesubtype, o.outcome AS status
        FROM plan p JOIN outcome o USING (id)
        WHERE o.outcome IN ('copy', 'move', 'keep', 'present') AND p.dest IS NOT NULL)
SELECT id_hex, name, size, timemodified, timeborn, timebornsrc, mimetype, mimesubtype, status FROM new
UNION ALL
SELECT {id_hex('id')}, backup.name, backup.size, backup.timemodified, backup.timeborn, backup.timebornsrc,
       backup.mimetype, backup.mimesubtype, 'ok'
FROM b WHERE id NOT IN (SELECT id FROM new)
"""


# -- scalar parsers ---------------------------------------------------------------

_IP = "CAST(v100 // 100 AS VARCHAR)"
_CC = "lpad(CAST(v100 % 100 AS VARCHAR), 2, '0')"
_SECS = "(v100 // 100)"
EVENTS_DURATION_TEXT = f"""
  SELECT event_id, CASE event_type
      WHEN 'view' THEN {_IP} || '.' || {_CC} || ' s'
      WHEN 'click' THEN CAST({_SECS} // 3600 AS VARCHAR) || ':' || lpad(CAST(({_SECS} // 60) % 60 AS VARCHAR), 2, '0')
                        || ':' || lpad(CAST({_SECS} % 60 AS VARCHAR), 2, '0')
      WHEN 'purchase' THEN {_IP}
      WHEN 'error' THEN 'v' || {_IP} || '.' || {_CC} || '.' || {_CC}
      ELSE '0:' || {_IP} || '.' || {_CC} || ':10' END AS text
  FROM (SELECT event_id, event_type, CAST(floor(value * 100) AS BIGINT) AS v100 FROM events)
"""

_ATOI = "CASE WHEN regexp_matches({0}, '^[+\\-]?[0-9]+$') THEN TRY_CAST({0} AS BIGINT) END"
_DPART = "coalesce(" + _ATOI.format("string_split(trim(text), ':')[{i}]") + ", 0)"
ORACLE["duration_parse"] = f"""
WITH d AS ({EVENTS_DURATION_TEXT}),
x AS (SELECT *, regexp_extract_all(trim(text), '[0-9\\.]+') AS nums, string_split(trim(text), ':') AS parts FROM d)
SELECT event_id, text, CAST(CASE
    WHEN trim(text) = '' THEN 0
    WHEN len(nums) = 1 THEN coalesce(TRY_CAST(trunc(CASE WHEN regexp_matches(nums[1], '^(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)$')
                                                  THEN TRY_CAST(nums[1] AS DOUBLE) END) AS BIGINT), 0)
    WHEN len(parts) = 3 THEN {_DPART.format(i=1)} * 3600 + {_DPART.format(i=2)} * 60 + {_DPART.format(i=3)}
    ELSE 0 END AS BIGINT) AS seconds
FROM x
"""


def _coord_sql(centi: str, pos: str, neg: str, salt: str) -> tuple[str, str]:
    a = f"abs({centi})"
    dec = (f"(CASE WHEN {centi} < 0 THEN '-' ELSE '' END || CAST({a} // 100 AS VARCHAR) || '.' "
           f"|| lpad(CAST({a} % 100 AS VARCHAR), 2, '0'))")
    tot = f"(({a} % 100) * 36)"
    dms = (f"(CAST({a} // 100 AS VARCHAR) || ' deg ' || CAST({tot} // 60 AS VARCHAR) || ''' ' "
           f"|| CAST({tot} % 60 AS VARCHAR) || '.' || lpad(CAST(({salt}) % 100 AS VARCHAR), 2, '0') || '\" ' "
           f"|| CASE WHEN {centi} < 0 THEN '{neg}' ELSE '{pos}' END)")
    return dec, dms


_LATD, _LATM = _coord_sql("((event_id * 37) % 18000 - 9000)", "N", "S", "event_id")
_LNGD, _LNGM = _coord_sql("((event_id * 91) % 36000 - 18000)", "E", "W", "event_id * 3")
EVENTS_POSITION_TEXT = f"""
  SELECT event_id,
         CASE event_type WHEN 'view' THEN {_LATD} || ', ' || {_LNGD}
                         WHEN 'click' THEN {_LATM} || ', ' || {_LNGM}
                         WHEN 'purchase' THEN {_LATD}
                         WHEN 'error' THEN 'abc bdf'
                         ELSE {_LATD} || ' ' || {_LNGD} || ' 12.5' END AS position,
         CASE WHEN event_type = 'purchase' THEN {_LATD} ELSE {_LATM} END AS lat_text
  FROM events
"""

_F0 = ("coalesce(CASE WHEN regexp_matches({0}, '^[+\\-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)$') "
       "THEN TRY_CAST({0} AS DOUBLE) END, 0.0)")


def _dms_sql(co: str, first: int, ref: str) -> str:
    v = (f"({_F0.format(f'{co}[{first}]')} + {_F0.format(f'{co}[{first + 1}]')} / 60.0 "
         f"+ {_F0.format(f'{co}[{first + 2}]')} / 3600.0)")
    return f"(CASE WHEN substr({ref}, 1, 1) IN ('S', 'W') THEN -{v} ELSE {v} END)"


_FLOAT_RE = "[+\\-]?(?:(?:0|[1-9]\\d*)(?:\\.\\d*)?|\\.\\d+)"
ORACLE["gps_parse"] = f"""
WITH p AS ({EVENTS_POSITION_TEXT}),
x AS (SELECT *, regexp_extract_all(position, '{_FLOAT_RE}') AS fl,
             regexp_extract_all(position, '[0-9\\.]+') AS co, regexp_extract_all(position, '[NSEW]+') AS re,
             regexp_extract_all(lat_text, '[0-9\\.]+') AS co1, regexp_extract_all(lat_text, '[NSEW]+') AS re1
      FROM p)
SELECT event_id, position,
  CAST(CASE WHEN position = '' THEN 0.0
            WHEN len(fl) = 2 AND TRY_CAST(fl[1] AS DOUBLE) IS NOT NULL AND TRY_CAST(fl[2] AS DOUBLE) IS NOT NULL
              THEN CAST(fl[1] AS DOUBLE)
            WHEN len(co) = 6 AND len(re) = 2 THEN {_dms_sql('co', 1, 're[1]')} ELSE 0.0 END AS FLOAT) AS lat,
  CAST(CASE WHEN position = '' THEN 0.0
            WHEN len(fl) = 2 AND TRY_CAST(fl[1] AS DOUBLE) IS NOT NULL AND TRY_CAST(fl[2] AS DOUBLE) IS NOT NULL
              THEN CAST(fl[2] AS DOUBLE)
            WHEN len(co) = 6 AND len(re) = 2 THEN {_dms_sql('co', 4, 're[2]')} ELSE 0.0 END AS FLOAT) AS lng,
  lat_text,
  CAST(CASE WHEN lat_text = '' THEN 0.0
            WHEN regexp_matches(lat_text, '^[+\\-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+\\-]?[0-9]+)?$')
              THEN CAST(lat_text AS DOUBLE)
            WHEN len(co1) = 3 AND len(re1) = 1 THEN {_dms_sql('co1', 1, 're1[1]')} ELSE 0.0 END AS FLOAT) AS lat_decimal
FROM x
"""

PARTS_AS_IMAGES = """
  SELECT p_partkey, CAST(p_size * 64 AS INTEGER) AS width, CAST((p_partkey % 50) * 48 AS INTEGER) AS height,
         CASE p_type WHEN 'ECONOMY' THEN '6' WHEN 'SMALL' THEN 'Rotate 90 CW' WHEN 'MEDIUM' THEN 'Horizontal (normal)'
                     WHEN 'PROMO' THEN 'Rotate 180' WHEN 'LARGE' THEN 'Unknown (0)' ELSE '' END AS orientation_tag,
         CAST(((p_size % 5) - 2) * 90 AS INTEGER) AS rotation
  FROM part
"""


def orientation_sql(tag: str, rot: str) -> str:
    return (f"coalesce(CASE {tag} WHEN '1' THEN 1 WHEN 'Horizontal (normal)' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN 3 "
            f"WHEN 'Rotate 180 CW' THEN 3 WHEN '4' THEN 4 WHEN '5' THEN 5 WHEN '6' THEN 6 WHEN 'Rotate 90 CW' THEN 6 "
            f"WHEN '7' THEN 7 WHEN '8' THEN 8 WHEN 'Rotate 270 CW' THEN 8 END, "
            f"CASE coalesce({rot}, 0) WHEN 0 THEN 1 WHEN -180 THEN 3 WHEN 180 THEN 3 WHEN 90 THEN 6 WHEN -90 THEN 8 "
            f"WHEN 270 THEN 8 END, 0)")


ORACLE["orientation_facts"] = f"""
WITH p AS ({PARTS_AS_IMAGES}),
o AS (SELECT *, {orientation_sql('orientation_tag', 'rotation')} AS orientation FROM p),
a AS (SELECT *, CASE WHEN orientation > 4 THEN height ELSE width END AS actual_width,
             CASE WHEN orientation > 4 THEN width ELSE height END AS actual_height FROM o)
SELECT p_partkey, width, height, orientation, actual_width, actual_height,
       CAST(CASE WHEN actual_width <= 0 OR actual_height <= 0 THEN 0.0
                 ELSE round(CAST(actual_width AS DOUBLE) / CAST(actual_height AS DOUBLE) * 100) / 100 END AS FLOAT)
         AS aspect_ratio,
       actual_width < actual_height AS portrait,
       CAST(round(CAST(width AS BIGINT) * CAST(height AS BIGINT) / 1e6) AS INTEGER) AS megapixels
FROM a
"""

_S = "CAST(CAST(floor({0}) AS BIGINT) AS VARCHAR)"
LINEITEM_RATIONALS = f"""
  SELECT l_orderkey, l_linenumber,
         CAST(l_linenumber AS VARCHAR) || '/' || {_S.format('l_quantity')} AS exposure_text,
         {_S.format('l_extendedprice')} || '/' || CASE WHEN l_tax = 0 THEN '0' ELSE {_S.format('l_quantity')} END
           AS fnumber_text,
         {_S.format('l_discount * 100')} || '/10' AS aperture_text,
         CASE WHEN l_returnflag = 'A' THEN {_S.format('l_quantity * 3')} END AS focal35_text,
         {_S.format('l_extendedprice')} || '/' || CAST(l_linenumber * 10 AS VARCHAR) AS focal_text
  FROM lineitem
"""


def rational_sql(e: str) -> str:
    parts = f"string_split({e}, '/')"
    return (f"(CASE WHEN len({parts}) = 2 AND {parts}[2] <> '0' AND {parts}[2] <> '' "
            f"THEN coalesce(TRY_CAST({parts}[1] AS DOUBLE), 0.0) / coalesce(TRY_CAST({parts}[2] AS DOUBLE), 0.0) END)")


def exposure_sql(e: str) -> str:
    parts = f"string_split({e}, '/')"
    a, b = f"{parts}[1]", f"{parts}[2]"
    na = f"(CASE WHEN regexp_matches({a}, '^[0-9]+$') THEN TRY_CAST({a} AS HUGEINT) END)"
    nb = f"(CASE WHEN regexp_matches({b}, '^[0-9]+$') THEN TRY_CAST({b} AS HUGEINT) END)"
    return (f"CASE WHEN len({parts}) = 2 AND {a} <> '1' AND strlen({a}) < strlen({b}) AND coalesce({na} > 0, false) "
            f"AND {nb} > 0 THEN '1/' || CAST({nb} // {na} AS VARCHAR) ELSE {e} END")


ORACLE["rational_tags"] = f"""
WITH r AS ({LINEITEM_RATIONALS})
SELECT l_orderkey, l_linenumber, {exposure_sql('exposure_text')} AS exposure,
       CAST(round({rational_sql('fnumber_text')} * 1000) / 1000 AS FLOAT) AS f_number,
       CAST(round({rational_sql('aperture_text')} * 1000) / 1000 AS FLOAT) AS aperture,
       CASE WHEN focal35_text IS NOT NULL
            THEN CASE WHEN regexp_matches(focal35_text, '^[+\\-]?[0-9]+$') THEN TRY_CAST(focal35_text AS INTEGER) END
            ELSE TRY_CAST(trunc(round({rational_sql('focal_text')} * 1000) / 1000) AS INTEGER) END AS focal_length
FROM r
"""


# -- text cleaning ------------------------------------------------------------------

from mediafold.functions import text as _X  # noqa: E402

_SP = _X.SPACE_CLASS


def g7(e: str) -> str:
    return (f"(CASE WHEN starts_with(coalesce({e}, ''), 'string with binary data') THEN '' ELSE "
            f"replace(regexp_replace(coalesce({e}, ''), '^{_SP}+|{_SP}+$', '', 'g'), '\"', '') END)")


def g8(e: str) -> str:
    v = f"string_split({g7(e)}, ':')[-1]"
    return f"(CASE WHEN strlen({v}) BETWEEN 15 AND 36 THEN lower({v}) ELSE '' END)"


_UNWANTED = ", ".join("'" + w.replace("'", "''") + "'" for w in _X.UNWANTED_DESCRIPTIONS)


def g10(e: str) -> str:
    v = g7(e)
    return (f"(CASE WHEN {v} IN ({_UNWANTED}) OR (starts_with({v}, 'DCIM\\') AND NOT contains({v}, ' ')) "
            f"THEN '' ELSE {v} END)")


def g11(e: str) -> str:
    v = f"coalesce({e}, '')"
    return (f"(CASE WHEN {v} = '' THEN '' WHEN starts_with({v}, '[') AND ends_with({v}, ']') THEN "
            f"coalesce(CASE WHEN json_valid({v}) AND len(list_filter(json_extract({v}, '$[*]'), "
            f"lambda x: json_type(x) NOT IN ('VARCHAR', 'NULL'))) = 0 "
            f"THEN array_to_string(list_transform(from_json({v}, '[\"VARCHAR\"]'), lambda x: coalesce(x, '')), ', ') END, {v}) "
            f"ELSE {g7(e)} END)")


LINES = """
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no
  FROM documents
"""
_TAGS = ("'[\"' || string_split(line, ' ')[1] || '\", \"' || coalesce(string_split(line, ' ')[2], '') || '\"]'")
ORACLE["clean_text"] = f"""
WITH l AS ({LINES})
SELECT doc_id, line_no, {g7('line')} AS clean, {g8('line')} AS uid, {g10('line')} AS description,
       {g11('line')} AS meta, {g11(_TAGS)} AS meta_list
FROM l
"""

PAGES_TITLES = """
  SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path, t AS title_text,
         CASE WHEN starts_with(url, 'http://') THEN replace(slug, ' ', '_') || '.jpg'
              WHEN starts_with(url, 'https://m.') THEN 'IMG_' || CAST(page_id AS VARCHAR) || '.JPG'
              WHEN contains(url, '.example.org/') THEN replace(slug, ' ', '--') || '.mp4'
              ELSE t || '.png' END AS title_in
  FROM (SELECT *, regexp_replace(lower(t), '[^a-z0-9 ]', '', 'g') AS slug
        FROM (SELECT *, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages))
"""

_TW = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _X.TITLE_WORDS.items())
_EXTS = "|".join(_X.KNOWN_EXTENSIONS)


def _file_title(r: str) -> str:
    word = f"coalesce(CASE lower(w) {_TW} END, upper(w[1]) || lower(w[2:]))"
    seg = (f"array_to_string(list_transform(list_filter(regexp_split_to_array(seg, '[-_ ]+'), "
           f"lambda w: NOT regexp_matches(w, '^[0-9]+$') AND length(w) > 1), lambda w: {word}), ' ')")
    return (f"array_to_string(list_filter(list_transform(string_split({r}, '--'), lambda seg: {seg}), "
            f"lambda x: x <> ''), ' / ')")


def _is_time_sql(s: str) -> str:
    from mediafold.functions.names import IS_DATE_PATTERN, IS_DATE_TIME_PATTERN
    return (f"({s} <> '' AND (regexp_extract({s}, '{IS_DATE_PATTERN}', 0) = {s} "
            f"OR regexp_extract({s}, '{IS_DATE_TIME_PATTERN}', 0) = {s}))")


def g9(e: str) -> str:
    v = g7(e)
    r = f"regexp_replace({v}, '(?i)\\.(?:{_EXTS})$', '')"
    lower_only = f"(regexp_extract({r}, '{_X.LOWER_WORD_PATTERN}', 0) = {r})"
    spaced = f"replace(replace({r}, '_', ' '), '  ', ' ')"
    ft = _file_title(r)
    initcap = (f"array_to_string(list_transform(string_split(lower(replace({r}, '-', ' ')), ' '), "
               f"lambda w: upper(w[1]) || w[2:]), ' ')")
    return (f"(CASE WHEN {v} = '' THEN '' "
            f"WHEN regexp_matches({r}, '{_X.GENERATED_NAME_PATTERN}') OR {_is_time_sql(r)} THEN '' "
            f"WHEN {r} = {v} THEN {v} WHEN NOT {lower_only} THEN {spaced} "
            f"WHEN {ft} <> '' THEN {ft} ELSE {initcap} END)")


_SEG = "string_split(path, '/')[-1]"
ORACLE["titles"] = f"""
WITH p AS ({PAGES_TITLES})
SELECT page_id, {_SEG} AS segment, title_in, {g9('title_in')} AS title, {g9(_SEG)} AS segment_title,
       {g10('title_text')} AS description
FROM p
"""

_AUTO = "list_filter(['hdr', 'burst', 'panorama', 'equirectangular'], lambda w: contains(lower({0}), w))"
ORACLE["keyword_sets"] = f"""
WITH b AS (SELECT 'documents' AS source, doc_id AS key, text AS body FROM documents
           UNION ALL SELECT 'pages', page_id, title_text FROM ({PAGES_TITLES})),
k AS (SELECT source, key, {_AUTO.format(g11('body'))} AS auto,
             list_sort(list_distinct(list_concat(regexp_extract_all(lower({g11('body')}), '{_X.WORD_PATTERN}'),
                                                 {_AUTO.format(g11('body'))}))) AS kw
      FROM b)
SELECT source, key, array_to_string(kw, ', ') AS keywords, CAST(len(kw) AS INTEGER) AS n_keywords,
       array_to_string(auto, ', ') AS auto_keywords, CASE WHEN list_contains(auto, 'hdr') THEN 3 ELSE 0 END AS image_type
FROM k
"""

PARTS_AS_MEDIA = """
  SELECT p_partkey,
         CASE p_type WHEN 'ECONOMY' THEN 'AVC1' WHEN 'SMALL' THEN 'hvc1' WHEN 'MEDIUM' THEN 'JPEG Baseline'
                     WHEN 'PROMO' THEN 'A_AAC' WHEN 'STANDARD' THEN 'vp09' ELSE 'Theora' END AS codec_tag,
         CASE p_type WHEN 'ECONOMY' THEN 'video/mp4' WHEN 'SMALL' THEN 'video/quicktime' WHEN 'MEDIUM' THEN 'image/jpeg'
                     WHEN 'PROMO' THEN 'audio/aac' WHEN 'STANDARD' THEN 'video/webm' ELSE 'application' END AS mime_tag,
         CASE WHEN p_size > 40 THEN 'Equirectangular' ELSE '' END AS projection,
         CASE WHEN p_size % 3 = 0 THEN upper(u) WHEN p_size % 3 = 1 THEN u ELSE h END AS document_tag
  FROM (SELECT *, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS u
        FROM (SELECT *, md5(p_name) AS h FROM part))
"""
_VC = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _X.VIDEO_CODECS.items())
_UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
ORACLE["codec_mime"] = f"""
WITH p AS ({PARTS_AS_MEDIA}),
c AS (SELECT *, lower(codec_tag) AS lc, string_split(mime_tag, '/') AS mp FROM p),
d AS (SELECT p_partkey,
             CASE WHEN contains(lc, 'jpeg') THEN 'jpeg' WHEN (CASE lc {_VC} END) IS NOT NULL THEN (CASE lc {_VC} END)
                  WHEN starts_with(lc, 'a_') THEN '' ELSE lc END AS codec,
             CASE WHEN mp[1] <> '' THEN mp[1] END AS mimetype,
             CASE WHEN len(mp) >= 2 THEN array_to_string(mp[2:], '/') END AS mimesubtype,
             CASE WHEN lower(projection) = 'equirectangular' THEN 'panorama' ELSE '' END AS keywords,
             CASE WHEN regexp_matches(lower(trim(document_tag)), '{_UUID}') THEN lower(trim(document_tag)) ELSE '' END
               AS document_id,
             coalesce(regexp_matches(lower(trim(document_tag)), '{_UUID}'), false) AS has_document_id
      FROM c)
SELECT *, coalesce(codec = 'avc1', false) AS is_avc,
       coalesce(mimetype IN ('video', 'audio', 'image'), false) AS backed_up
FROM d
"""

ORACLE["media_flags"] = f"""
WITH p AS ({EVENTS_POSITION_TEXT}),
e AS (SELECT e.event_id, e.event_type, e.value, e.ts, p.position,
             CASE e.event_type WHEN 'view' THEN strftime(e.ts, '%Y-%m-%d') WHEN 'click' THEN strftime(e.ts, '%Y%m%d')
                  WHEN 'purchase' THEN strftime(e.ts, '%Y-%m-%d %H:%M:%S')
                  WHEN 'error' THEN strftime(e.ts, '%Y_%m_%d_%H%M%S') ELSE strftime(e.ts, '%d.%m.%Y') END AS time_text,
             regexp_extract_all(p.position, '{_FLOAT_RE}') AS fl,
             regexp_extract_all(p.position, '[0-9\\.]+') AS co, regexp_extract_all(p.position, '[NSEW]+') AS re
      FROM events e JOIN p ON e.event_id = p.event_id),
ll AS (SELECT *,
  CAST(CASE WHEN len(fl) = 2 AND TRY_CAST(fl[1] AS DOUBLE) IS NOT NULL AND TRY_CAST(fl[2] AS DOUBLE) IS NOT NULL
              THEN CAST(fl[1] AS DOUBLE)
            WHEN len(co) = 6 AND len(re) = 2 THEN {_dms_sql('co', 1, 're[1]')} ELSE 0.0 END AS FLOAT) AS lat,
  CAST(CASE WHEN len(fl) = 2 AND TRY_CAST(fl[1] AS DOUBLE) IS NOT NULL AND TRY_CAST(fl[2] AS DOUBLE) IS NOT NULL
              THEN CAST(fl[2] AS DOUBLE)
            WHEN len(co) = 6 AND len(re) = 2 THEN {_dms_sql('co', 4, 're[2]')} ELSE 0.0 END AS FLOAT) AS lng
  FROM e)
SELECT event_id, time_text, {_is_time_sql('time_text')} AS is_time,
       (event_type <> 'error' AND ts IS NOT NULL AND coalesce(lat <> 0 AND lng <> 0, false)) AS has_time_and_place,
       coalesce((CASE WHEN value > 400 THEN 3 ELSE CAST(floor(value) AS INTEGER) % 3 END) = 3, false) AS is_hdr
FROM ll
"""


# -- tag documents (G14) ----------------------------------------------------------------

from mediafold.functions import dates as _D  # noqa: E402
from mediafold.operators import tags as _TG  # noqa: E402


def _kv(key: str, val: str) -> str:
    return f"'\"{key}\": \"' || {val} || '\"'"


_K = "regexp_extract(props, '(\\d+)', 1)"
_U = "CAST(user_id AS VARCHAR)"
_E = "CAST(event_id AS VARCHAR)"
_DT = "strftime(ts, '%Y:%m:%d %H:%M:%S')"
EVENTS_TAG_DOCS = f"""
  SELECT event_id, CASE event_type
    WHEN 'view' THEN '[{{"k": ' || {_K} || ', "ExifToolVersion": 12.5, ' || {_kv('Headline', "''")} || ', '
         || {_kv('Title', "'Trip ' || " + _U)} || ', "Make": "Canon", "ISO": ' || {_U}
         || ', "FocalLength": "5.6 mm", ' || {_kv('DateTimeOriginal', _DT)}
         || ', "Duration": "2.41 s", "ImageWidth": ' || CAST(user_id * 10 AS VARCHAR)
         || ', "Keywords": ["Sea","sky"], "SubSecTimeOriginal": "' || substr({_E}, 1, 3) || '"}}]'
    WHEN 'click' THEN '[{{"Make": "Nikon", "ISO": ' || {_U} || '}}, {{"CameraMake": "  ", "Make": "NIKON", '
         || '"Title": "0", ' || {_kv('Headline', "'Click ' || " + _E)} || ', "ISO": "0", "FocalLength": 35, '
         || {_kv('CreateDate', _DT + " || '+01:00'")}
         || ', "PixelXDimension": "640", "Keywords": "Foo; bar", "Rotation": 90}}]'
    WHEN 'purchase' THEN '{{"k": ' || {_K} || ', ' || {_kv('Model', "'M ' || " + _U)}
         || ', "Duration": "0:01:05", "DateTimeOriginal": "0000:00:00 00:00:00", ' || {_kv('DateTime', _DT)}
         || ', "GPSDateTime": "2024:01:02 03:04:05Z"}}'
    WHEN 'error' THEN '[{{"k": ' || {_K} || ', "Make": "x"'
    ELSE '{{"k": ' || {_K} || ', "Grouped": {{"Make": "inner"}}, "FlashFired": "True", '
         || '"GPSAltitude": "84.4 m Above Sea Level", "HDRImageType": "3", "ApertureValue": 2.8, '
         || '"Artist": "null", "Creator": "' || {_U} || '"}}'
  END AS doc FROM events
"""

_EMPTY = ", ".join(f"'{v}'" for v in _TG.EMPTY_VALUES)


def _trim_sql(v: str) -> str:
    return f"regexp_replace({v}, '^{_SP}+|{_SP}+$', '', 'g')"


def _empty_sql(v: str) -> str:
    return f"(lower(regexp_replace({_trim_sql(v)}, '^[%*]+|[%*]+$', '', 'g')) IN ({_EMPTY}))"


def first_tag_sql(m: str, names: list[str]) -> str:
    vals = [f"map_extract_value({m}, '{n}')" for n in names]
    return "coalesce(" + ", ".join(f"CASE WHEN NOT {_empty_sql(v)} THEN {v} END" for v in vals) + ")"


_LEAD = "regexp_extract(coalesce({0}, ''), '^\\s*([+\\-]?(?:[0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)(?:[eE][+\\-]?[0-9]+)?)', 1)"


def _lead_num(v: str) -> str:
    x = _LEAD.format(v)
    return f"(CASE WHEN {x} <> '' THEN TRY_CAST({x} AS DOUBLE) END)"


def tag_datetime_sql(v: str) -> dict[str, str]:
    p = _D.TAG_DATETIME_PATTERN
    g = [f"regexp_extract(coalesce({v}, ''), '{p}', {i})" for i in range(9)]
    y, mo, d, h, mi, s = (f"TRY_CAST({g[i]} AS INTEGER)" for i in range(1, 7))
    off = g[8]
    ok = (f"coalesce({y} >= 1 AND {mo} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND 31 AND {h} BETWEEN 0 AND 23 "
          f"AND {mi} BETWEEN 0 AND 59 AND {s} BETWEEN 0 AND 59, false)")
    local = (f"((date_diff('day', DATE '1970-01-01', make_date(least(greatest({y}, 1), 9999), "
             f"least(greatest({mo}, 1), 12), 1)) + {d} - 1) * 86400 + {h} * 3600 + {mi} * 60 + {s})")
    digits = f"regexp_replace({off}, '[^0-9]', '', 'g')"
    off_s = (f"(CASE WHEN {off} = 'Z' THEN 0 WHEN {off} <> '' THEN (CAST(substr({digits}, 1, 2) AS INTEGER) * 3600 "
             f"+ CAST(substr({digits}, 3, 2) AS INTEGER) * 60) * (CASE WHEN starts_with({off}, '-') THEN -1 ELSE 1 END) END)")
    return {
        "local": f"CAST(CASE WHEN {ok} THEN {local} END AS BIGINT)",
        "offset": f"CAST(CASE WHEN {ok} THEN {off_s} END AS INTEGER)",
        "utc": f"CAST(CASE WHEN {ok} THEN {local} - coalesce({off_s}, 0) END AS BIGINT)",
    }


def _duration_sql(v: str) -> str:
    t = f"trim(coalesce({v}, ''))"
    nums = f"regexp_extract_all({t}, '[0-9\\.]+')"
    parts = f"string_split({t}, ':')"
    part = ("coalesce(CASE WHEN regexp_matches({p}[{i}], '^[+\\-]?[0-9]+$') THEN TRY_CAST({p}[{i}] AS BIGINT) END, 0)")
    return (f"CAST(CASE WHEN {t} = '' THEN 0 WHEN len({nums}) = 1 THEN coalesce(TRY_CAST(trunc(CASE WHEN "
            f"regexp_matches({nums}[1], '^(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN TRY_CAST({nums}[1] AS DOUBLE) END) "
            f"AS BIGINT), 0) WHEN len({parts}) = 3 THEN {part.format(p=parts, i=1)} * 3600 + "
            f"{part.format(p=parts, i=2)} * 60 + {part.format(p=parts, i=3)} ELSE 0 END AS BIGINT)")


def convert_sql(v: str, kind: str) -> str:
    if kind == "string":
        return _trim_sql(v)
    if kind == "int":
        i = f"coalesce(TRY_CAST(trunc({_lead_num(v)}) AS BIGINT), 0)"
        return f"(CASE WHEN {i} <> 0 THEN {i} END)"
    if kind in ("float", "float32"):
        f = _lead_num(v)
        e = f"(CASE WHEN {f} <> 0 THEN {f} END)"
        return f"CAST({e} AS FLOAT)" if kind == "float32" else e
    if kind == "duration":
        return _duration_sql(v)
    if kind == "bool":
        return f"(lower({_trim_sql(v)}) IN ('t', 'true') OR coalesce(TRY_CAST({v} AS DOUBLE) <> 0, false))"
    if kind == "keywords":
        return (f"array_to_string(list_sort(list_distinct(regexp_extract_all(lower({g11(v)}), "
                f"'{_X.WORD_PATTERN}'))), ', ')")
    raise ValueError(kind)


def _tag_query() -> str:
    from mediafold.plans.queries import TAG_OUTPUT
    sel = []
    for f in TAG_OUTPUT:
        names, kind = _TG.TAG_FIELDS[f]
        v = first_tag_sql("m", names)
        if kind == "time":
            continue
        expr = convert_sql(v, kind)
        if kind == "keywords":
            expr = f"coalesce({expr}, '')"
        sel.append(f"{expr} AS {f}")
    tt = tag_datetime_sql(first_tag_sql("m", _TG.TAG_FIELDS["taken_at"][0]))
    ct = tag_datetime_sql(first_tag_sql("m", _TG.TAG_FIELDS["created_at"][0]))
    gt = tag_datetime_sql(first_tag_sql("m", _TG.TAG_FIELDS["taken_gps"][0]))
    sub = [f"map_extract_value(m, '{t}')" for t in _TG.SUBSEC_TAGS]

    def ns(v):
        return (f"(CASE WHEN regexp_matches({v}, '^[0-9]+$') AND length({v}) <= 9 AND TRY_CAST({v} AS BIGINT) > 0 "
                f"THEN TRY_CAST(rpad({v}, 9, '0') AS INTEGER) END)")
    kind = ("CASE WHEN contains(doc, 'ExifToolVersion') THEN 'exiftool' WHEN contains(doc, 'albumData') THEN 'album' "
            "WHEN contains(doc, 'photoTakenTime') THEN 'photo' ELSE 'unknown' END")
    wrapped = "CASE WHEN starts_with(trim(doc), '{') THEN '[' || trim(doc) || ']' ELSE trim(doc) END"
    return f"""
WITH d AS ({EVENTS_TAG_DOCS}),
w AS (SELECT event_id, doc, {wrapped} AS wdoc FROM d),
p AS (SELECT event_id, {kind} AS kind,
             CASE WHEN json_valid(wdoc) THEN list_reduce(json_transform(wdoc, '["MAP(VARCHAR, VARCHAR)"]'),
                                                          lambda a, b: map_concat(a, b)) END AS m
      FROM w)
SELECT event_id, kind, m IS NULL AS error, map_extract_value(m, 'k') AS k, {', '.join(sel)},
       {tt['utc']} AS taken_utc, {tt['offset']} AS taken_offset, {ct['utc']} AS created_utc, {gt['utc']} AS gps_utc,
       coalesce({', '.join(ns(v) for v in sub)}, 0) AS taken_ns
FROM p
"""


ORACLE["tag_precedence"] = _tag_query()


# -- Exif tag rows ---------------------------------------------------------------------

_PT = ["Make", "Model", "ExposureTime", "FNumber", "ISOSpeedRatings", "Orientation", "Software"]
_PT_LIST = "[" + ", ".join(f"'{t}'" for t in _PT) + "]"
LINEITEM_TAG_ROWS = f"""
  SELECT 'img/' || CAST(l_orderkey AS VARCHAR) AS path, CASE WHEN l_returnflag = 'R' THEN 'IFD1' ELSE 'IFD0' END AS ifd,
         {_PT_LIST}[CAST(l_partkey % 7 + 1 AS INTEGER)] AS tag,
         CASE WHEN l_discount = 0 THEN '' ELSE l_returnflag || CAST(l_suppkey AS VARCHAR)
              || CASE WHEN l_linestatus = 'F' THEN chr(0) || 'junk' ELSE '' END END AS value,
         CAST(l_linenumber AS INTEGER) AS ord
  FROM lineitem
"""


def picked_sql(rows: str) -> str:
    return f"""
  SELECT path, tag, arg_max(v, {{'m': ifd <> 'IFD1', 'o': CASE WHEN ifd <> 'IFD1' THEN ord ELSE -ord END, 'v': v}}) AS value
  FROM (SELECT path, ifd, tag, string_split(value, chr(0))[1] AS v, ord FROM {rows})
  WHERE tag <> '' AND v <> ''
  GROUP BY path, tag
"""


def pivot_sql(picked: str, tags: list[str]) -> str:
    cols = ", ".join(f"max(value) FILTER (WHERE tag = '{t}') AS \"{t}\"" for t in tags)
    return f"SELECT path, {cols} FROM {picked} GROUP BY path"


ORACLE["exif_pivot"] = f"""
WITH r AS ({LINEITEM_TAG_ROWS}), p AS ({picked_sql('r')})
{pivot_sql('p', _PT)}
"""


def _crow(ifd: str, tag: str, value: str, o: int) -> str:
    return f"{{'ifd': '{ifd}', 'tag': '{tag}', 'value': {value}, 'ord': {o}}}"


_CK = "CAST(c_custkey AS VARCHAR)"
CUSTOMER_TAG_ROWS = f"""
  SELECT path, r.ifd AS ifd, r.tag AS tag, r.value AS value, r.ord AS ord FROM (
  SELECT {_CK} AS path, unnest([
    {_crow('IFD0', 'Artist', 'c_name', 1)},
    {_crow('IFD0', 'Copyright', "' \"' || c_mktsegment || '\" '", 2)},
    {_crow('IFD1', 'Model', "'Thumb ' || " + _CK, 3)},
    {_crow('IFD0', 'Model', "CASE WHEN c_acctbal > 0 THEN 'Model ' || CAST(c_nationkey AS VARCHAR) ELSE '' END", 4)},
    {_crow('IFD0', 'CameraMake', "'Vendor'", 5)},
    {_crow('IFD0', 'ImageDescription', "CASE WHEN c_mktsegment = 'BUILDING' THEN 'OLYMPUS DIGITAL CAMERA' WHEN c_mktsegment = 'MACHINERY' THEN 'HDR burst of ' || c_name ELSE '  Shot ' || " + _CK + " || '  ' END", 6)},
    {_crow('IFD0', 'Flash', 'CAST(c_nationkey AS VARCHAR)', 7)},
    {_crow('IFD0', 'FocalLength', "CAST(c_custkey % 300 AS VARCHAR) || '/10'", 8)},
    {_crow('IFD0', 'FocalLengthIn35mmFilm', "CASE WHEN c_nationkey > 20 THEN CAST(c_nationkey * 2 AS VARCHAR) ELSE '' END", 9)},
    {_crow('IFD0', 'ISOSpeedRatings', 'CAST(c_custkey % 3200 AS VARCHAR)', 10)},
    {_crow('IFD0', 'PixelXDimension', 'CAST(c_custkey % 4000 + 100 AS VARCHAR)', 11)},
    {_crow('IFD0', 'ImageLength', 'CAST(c_nationkey * 100 + 50 AS VARCHAR)', 12)},
    {_crow('IFD0', 'ExposureTime', "'10/' || " + _CK, 13)},
    {_crow('IFD0', 'Software', "'App' || chr(0) || 'junk'", 14)},
    {_crow('IFD0', 'ProjectionType', "CASE WHEN c_nationkey = 5 THEN 'equirectangular' ELSE '' END", 15)}
  ]) AS r FROM customer)
"""

_EXIF_USED = ["Artist", "Copyright", "Model", "CameraModel", "Make", "CameraMake", "Software", "ImageDescription",
              "Flash", "FocalLength", "FocalLengthIn35mmFilm", "ISOSpeedRatings", "PixelXDimension", "ImageWidth",
              "PixelYDimension", "ImageLength", "Orientation", "ExposureTime", "ProjectionType"]


def _atoi_sql(v: str) -> str:
    return f"(CASE WHEN regexp_matches({v}, '^[+\\-]?[0-9]+$') THEN TRY_CAST({v} AS INTEGER) END)"


def _txt(t: str) -> str:
    return f"CASE WHEN \"{t}\" IS NOT NULL THEN {g7(chr(34) + t + chr(34))} END"


_AUTO_D = "list_filter(['hdr', 'burst', 'panorama', 'equirectangular'], lambda w: contains(lower({0}), w))"
ORACLE["exif_text"] = f"""
WITH r AS ({CUSTOMER_TAG_ROWS}), p AS ({picked_sql('r')}), w AS ({pivot_sql('p', _EXIF_USED)}),
x AS (SELECT *,
        CASE WHEN "ImageDescription" IS NOT NULL THEN {_AUTO_D.format(g11('"ImageDescription"'))} ELSE [] END AS auto,
        coalesce({_atoi_sql('"Flash"')} % 2 = 1, false) AS flash_on
      FROM w)
SELECT path,
  CASE WHEN "Artist" IS NOT NULL THEN {g11(_txt('Artist'))} END AS artist,
  {_txt('Copyright')} AS copyright,
  coalesce({_txt('Model')}, {_txt('CameraModel')}) AS camera_model,
  coalesce({_txt('Make')}, {_txt('CameraMake')}) AS camera_make,
  {_txt('Software')} AS software,
  CASE WHEN "ImageDescription" IS NOT NULL THEN {g10('"ImageDescription"')} END AS description,
  array_to_string(list_sort(list_distinct(list_concat(auto, CASE WHEN flash_on THEN ['flash'] ELSE [] END,
     CASE WHEN "ProjectionType" IS NOT NULL THEN ['panorama'] ELSE [] END))), ', ') AS keywords,
  flash_on AS flash,
  CASE WHEN "FocalLengthIn35mmFilm" IS NOT NULL THEN {_atoi_sql('"FocalLengthIn35mmFilm"')}
       ELSE TRY_CAST(trunc(round({rational_sql('"FocalLength"')} * 1000) / 1000) AS INTEGER) END AS focal_length,
  {_atoi_sql('"ISOSpeedRatings"')} AS iso,
  CASE WHEN "PixelXDimension" IS NOT NULL THEN {_atoi_sql('"PixelXDimension"')} ELSE {_atoi_sql('"ImageWidth"')} END AS width,
  CASE WHEN "PixelYDimension" IS NOT NULL THEN {_atoi_sql('"PixelYDimension"')} ELSE {_atoi_sql('"ImageLength"')} END AS height,
  CASE WHEN "Orientation" IS NOT NULL THEN {_atoi_sql('"Orientation"')} ELSE 1 END AS orientation,
  CASE WHEN "ExposureTime" IS NOT NULL THEN {exposure_sql('"ExposureTime"')} END AS exposure,
  CASE WHEN list_contains(auto, 'hdr') THEN 3 END AS image_type
FROM x
"""


# -- numbers with units ---------------------------------------------------------------------

_Q = "CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR)"
_DTL = "strftime(l_shipdate, '%Y:%m:%d %H:%M:%S')"
LINEITEM_NUMBER_TEXTS = f"""
  SELECT l_orderkey, l_linenumber,
    CASE WHEN l_linestatus = 'O' THEN ' ' || {_Q} || ' ' ELSE {_Q} || CASE WHEN l_returnflag = 'R' THEN 'x' ELSE '' END END
      AS int_text,
    CASE WHEN l_returnflag = 'N' THEN CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) || '.'
         || lpad(CAST(CAST(floor(l_extendedprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') ELSE 'n/a' END AS float_text,
    CASE WHEN l_returnflag = 'A' THEN '12 m, 13 m' ELSE {_Q} || '.' || CAST(l_linenumber AS VARCHAR) || ' m Above Sea Level' END
      AS altitude_text,
    CASE WHEN l_linenumber = 1 THEN CAST(CAST(floor(l_tax * 100) AS BIGINT) AS VARCHAR) || '.5E-2'
         WHEN l_linenumber = 2 THEN '30000000' || lpad({_Q}, 2, '0') || ' units'
         ELSE CAST(CAST(floor(l_tax * 100) AS BIGINT) AS VARCHAR) || '.5 mm' END AS unit_text,
    CASE WHEN l_returnflag = 'R' THEN '-3' ELSE CAST(l_linenumber * 7 AS VARCHAR) END AS subsec_text,
    CASE WHEN l_linenumber = 7 THEN '0000:00:00 00:00:00' WHEN l_linestatus = 'O' THEN {_DTL} || '+05:30'
         WHEN l_returnflag = 'R' THEN {_DTL} || CASE WHEN l_linenumber = 3 THEN '.25000000019Z' ELSE '.25Z' END ELSE {_DTL} END AS dt_text,
    CAST(l_linenumber AS VARCHAR) AS flash_text
  FROM lineitem
"""


def _tag_dt_full(v: str) -> dict[str, str]:
    d = tag_datetime_sql(v)
    p = _D.TAG_DATETIME_PATTERN
    frac = f"regexp_extract(coalesce({v}, ''), '{p}', 7)"
    y = f"regexp_extract(coalesce({v}, ''), '{p}', 1)"
    d["micros"] = (f"CASE WHEN {d['utc']} IS NOT NULL THEN CASE WHEN {frac} <> '' THEN "
                   f"CAST(rpad(substr({frac}, 1, 6), 6, '0') AS INTEGER) ELSE 0 END END")
    return d


_NDT = _tag_dt_full("dt_text")
_TRIM_WS = "regexp_replace(int_text, '^\\s+|\\s+$', '', 'g')"
_FL1 = "regexp_extract_all(altitude_text, '" + _FLOAT_RE + "')"
ORACLE["number_tags"] = f"""
WITH t AS ({LINEITEM_NUMBER_TEXTS})
SELECT l_orderkey, l_linenumber,
  coalesce(CASE WHEN regexp_matches({_TRIM_WS}, '^[+\\-]?[0-9]+$') THEN TRY_CAST({_TRIM_WS} AS INTEGER) END, 0) AS int_value,
  coalesce(CASE WHEN regexp_matches(float_text, '^[+\\-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+\\-]?[0-9]+)?$')
                THEN TRY_CAST(float_text AS DOUBLE) END, 0.0) AS float_value,
  CASE WHEN len({_FL1}) = 1 AND TRY_CAST({_FL1}[1] AS DOUBLE) <> 0
       THEN TRY_CAST(trunc(TRY_CAST({_FL1}[1] AS DOUBLE)) AS INTEGER) ELSE 0 END AS altitude,
  {_lead_num('unit_text')} AS unit_value,
  coalesce(TRY_CAST(trunc({_lead_num('unit_text')}) AS BIGINT), 0) AS unit_int,
  coalesce(CASE WHEN regexp_matches(subsec_text, '^[0-9]+$') AND length(subsec_text) <= 9
                     AND TRY_CAST(subsec_text AS BIGINT) > 0 THEN TRY_CAST(rpad(subsec_text, 9, '0') AS INTEGER) END, 0)
    AS subsec_ns,
  {_NDT['utc']} AS dt_utc, {_NDT['offset']} AS dt_offset, {_NDT['micros']} AS dt_micros,
  coalesce({_atoi_sql('flash_text')} % 2 = 1, false) AS flash
FROM t
"""


# -- zones and taken times ------------------------------------------------------------------

def _region_zone_sql() -> str:
    from mediafold.plans.queries import REGION_ZONES
    return "CASE r_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REGION_ZONES.items()) + " ELSE 'Asia/Dubai' END"


NATION_BOXES = f"""
  SELECT {_region_zone_sql()} AS zone, CAST(n_nationkey AS INTEGER) AS priority,
         CAST(-90 + (n_nationkey % 5) * 36 - 2 AS DOUBLE) AS lat_min, CAST(-90 + (n_nationkey % 5) * 36 + 38 AS DOUBLE) AS lat_max,
         CAST(-180 + floor(n_nationkey / 5) * 72 - 2 AS DOUBLE) AS lng_min, CAST(-180 + floor(n_nationkey / 5) * 72 + 74 AS DOUBLE) AS lng_max
  FROM nation JOIN region ON n_regionkey = r_regionkey
"""

EVENT_POINTS = f"""
  SELECT event_id,
    CAST(CASE WHEN position = '' THEN 0.0
              WHEN len(fl) = 2 AND TRY_CAST(fl[1] AS DOUBLE) IS NOT NULL AND TRY_CAST(fl[2] AS DOUBLE) IS NOT NULL
                THEN CAST(fl[1] AS DOUBLE)
              WHEN len(co) = 6 AND len(re) = 2 THEN {_dms_sql('co', 1, 're[1]')} ELSE 0.0 END AS FLOAT) AS lat,
    CAST(CASE WHEN position = '' THEN 0.0
              WHEN len(fl) = 2 AND TRY_CAST(fl[1] AS DOUBLE) IS NOT NULL AND TRY_CAST(fl[2] AS DOUBLE) IS NOT NULL
                THEN CAST(fl[2] AS DOUBLE)
              WHEN len(co) = 6 AND len(re) = 2 THEN {_dms_sql('co', 4, 're[2]')} ELSE 0.0 END AS FLOAT) AS lng
  FROM (SELECT *, regexp_extract_all(position, '{_FLOAT_RE}') AS fl, regexp_extract_all(position, '[0-9\\.]+') AS co,
               regexp_extract_all(position, '[NSEW]+') AS re FROM ({EVENTS_POSITION_TEXT}))
"""

ZONED_POINTS = f"""
  SELECT pt.event_id, pt.lat, pt.lng, z.zone FROM ({EVENT_POINTS}) pt LEFT JOIN (
    SELECT p.event_id, arg_min(b.zone, {{'p': b.priority, 'z': b.zone}}) AS zone
    FROM ({EVENT_POINTS}) p JOIN ({NATION_BOXES}) b
      ON CAST(p.lat AS DOUBLE) >= b.lat_min AND CAST(p.lat AS DOUBLE) < b.lat_max
     AND CAST(p.lng AS DOUBLE) >= b.lng_min AND CAST(p.lng AS DOUBLE) < b.lng_max
    WHERE p.lat <> 0 AND p.lng <> 0
    GROUP BY p.event_id) z ON pt.event_id = z.event_id
"""
ORACLE["zone_join"] = ZONED_POINTS


def wall_sql(x: str, z: str) -> str:
    return f"CAST(epoch(timezone({z}, to_timestamp({x}))) AS BIGINT)"


def instant_sql(x: str, z: str) -> str:
    return f"CAST(epoch(timezone({z}, make_timestamp(CAST({x} AS BIGINT) * 1000000))) AS BIGINT)"


_FMT = "'%Y:%m:%d %H:%M:%S'"
EVENTS_TIME_TAGS = f"""
  SELECT event_id,
    CASE event_type WHEN 'view' THEN strftime(ts, {_FMT}) WHEN 'click' THEN strftime(ts, {_FMT}) || '+02:00'
         WHEN 'purchase' THEN '' WHEN 'error' THEN strftime(ts, {_FMT}) || 'Z' ELSE strftime(ts, {_FMT}) || '+08:00' END
      AS taken_text,
    CASE WHEN user_id % 4 = 0 THEN strftime(ts + to_hours(CAST(user_id % 50 AS BIGINT)), {_FMT}) ELSE '' END AS created_text,
    strftime(ts - to_hours(1), {_FMT}) || 'Z' AS gps_text,
    CASE WHEN user_id % 2 = 0 THEN 'video/mp4' ELSE 'image/jpeg' END AS mime
  FROM events
"""


def _resolve_sql() -> str:
    tk, cr, gp = tag_datetime_sql("taken_text"), tag_datetime_sql("created_text"), tag_datetime_sql("gps_text")
    p = _D.TAG_DATETIME_PATTERN
    off_text = (f"CASE WHEN {tk['utc']} IS NOT NULL THEN regexp_extract(coalesce(taken_text, ''), '{p}', 8) END")
    layouts = ", ".join(f"'{x}'" for x in _D.REFERENCE_OFFSET_LAYOUTS)

    def birth(policy: str) -> str:
        keep = f"(tz <> '' OR coalesce(off_text, '') IN ({layouts}))"
        if policy == "respect":
            keep = f"({keep} OR coalesce(off_text, '') <> '')"
        day = "(CAST(floor(ta / 86400) AS BIGINT) * 86400)"
        shift = f"({day} - {instant_sql(day, "'Asia/Chongqing'")})"
        return (f"CASE WHEN year(make_timestamp(ta * 1000000)) > 1900 THEN "
                f"CASE WHEN {keep} THEN ta ELSE ta - {shift} END END")
    return f"""
WITH z AS ({ZONED_POINTS}),
s0 AS (
  SELECT t.event_id, t.mime, z.zone, coalesce(z.lat <> 0 AND z.lng <> 0, false) AS pos, {off_text} AS off_text,
         {tk['utc']} AS ta, {tk['local']} AS ta_wall, coalesce({tk['offset']}, 0) AS ta_off,
         {tk['utc']} AS tl, {tk['local']} AS tl_wall, coalesce({tk['offset']}, 0) AS tl_off, '' AS tz,
         {cr['utc']} AS c_utc, {cr['local']} AS c_wall, {cr['offset']} AS c_off, {gp['utc']} AS g_utc
  FROM ({EVENTS_TIME_TAGS}) t JOIN z ON t.event_id = z.event_id),
s1 AS (SELECT * REPLACE (
         CASE WHEN c_utc IS NOT NULL THEN c_utc ELSE ta END AS ta,
         CASE WHEN c_utc IS NOT NULL THEN c_wall ELSE ta_wall END AS ta_wall,
         CASE WHEN c_utc IS NOT NULL THEN coalesce(c_off, 0) ELSE ta_off END AS ta_off) FROM s0),
s2 AS (SELECT *, (ta IS NULL AND tl IS NULL AND g_utc IS NOT NULL) AS g FROM s1),
s3 AS (SELECT * REPLACE (CASE WHEN g THEN 'UTC' ELSE tz END AS tz, CASE WHEN g THEN g_utc ELSE ta_wall END AS ta_wall,
                         CASE WHEN g THEN 0 ELSE ta_off END AS ta_off, CASE WHEN g THEN g_utc ELSE ta END AS ta) FROM s2),
s4 AS (SELECT *, (ta IS NOT NULL AND tl IS NOT NULL AND abs(ta - tl) > {27 * 3600}) AS far FROM s3),
s5 AS (SELECT * REPLACE (CASE WHEN far THEN ta ELSE tl END AS tl, CASE WHEN far THEN ta_wall ELSE tl_wall END AS tl_wall,
                         CASE WHEN far THEN ta_off ELSE tl_off END AS tl_off, CASE WHEN far THEN ta ELSE ta_wall END AS ta_wall)
       FROM s4),
s6 AS (SELECT *, (tl IS NOT NULL AND tl_off <> 0) AS has_off FROM s5),
s7 AS (SELECT *, (NOT has_off AND tl IS NULL AND coalesce(mime IN ('video/mp4', 'video/quicktime'), false)) AS mp4 FROM s6),
s8 AS (SELECT * REPLACE (CASE WHEN mp4 THEN 'UTC' ELSE tz END AS tz, CASE WHEN mp4 THEN ta ELSE ta_wall END AS ta_wall)
       FROM s7),
s9 AS (SELECT * REPLACE (CASE WHEN pos AND zone IS NOT NULL THEN zone ELSE tz END AS tz) FROM s8),
s10 AS (SELECT *, CASE WHEN tz = '' THEN 'UTC' ELSE tz END AS loc, (pos AND tl IS NOT NULL) AS p_local,
               (pos AND tl IS NULL AND ta IS NOT NULL) AS p_taken FROM s9),
s11 AS (SELECT * REPLACE (CASE WHEN p_local THEN {instant_sql('tl_wall', 'loc')} ELSE ta END AS ta,
                          CASE WHEN p_taken THEN {wall_sql('ta', 'loc')} ELSE tl_wall END AS tl_wall,
                          CASE WHEN p_taken THEN ta ELSE tl END AS tl) FROM s10),
s12 AS (SELECT * REPLACE (CASE WHEN tl IS NULL AND ta IS NOT NULL AND tz = '' THEN ta_wall
                               WHEN tl IS NULL AND ta IS NOT NULL THEN {wall_sql('ta', 'loc')} ELSE tl_wall END AS tl_wall)
        FROM s11)
SELECT event_id, ta AS taken_utc, tl_wall AS taken_local, tz AS time_zone,
       {birth('respect')} AS birth, {birth('reference')} AS birth_reference
FROM s12
"""


ORACLE["resolve_time"] = _resolve_sql()


def _normalize_sql() -> str:
    def nth(i, *texts):
        return f"CASE {i} % {len(texts)} " + " ".join(f"WHEN {n} THEN {t}" for n, t in enumerate(texts)) + " END"
    u, k = "CAST(user_id AS VARCHAR)", "CAST(event_id AS VARCHAR)"
    tags = {
        "DateTimeOriginal": "taken_text", "CreateDate": "created_text", "GPSDateTime": "gps_text", "MIMEType": "mime",
        "GPSPosition": "CASE WHEN event_id % 5 <> 0 THEN position END", "GPSLatitude": "lat_text",
        "GPSLongitude": "CASE WHEN event_id % 10 <> 0 THEN lat_text END",
        "GPSAltitude": f"{k} || '.5 m Above Sea Level'", "SubSecTimeOriginal": nth("event_id", "'25'", "'x'", "'0'"),
        "Headline": nth("user_id", f"'let_it_snow-' || {u} || 'x.jpg'", "'IMG_1234.jpg'", "''", f"'Plain ' || {u}"),
        "Subject": nth("event_id", f"""'["One ' || {u} || '", "Two"]'""", "'[1]'", """'  "Quoted" '"""),
        "Artist": nth("user_id", """'["A", "B"]'""", "'null'"), "Creator": u,
        "Description": nth("event_id", "'HDR Burst at sea'", "'OLYMPUS DIGITAL CAMERA'", """'a "panorama" of '""", u),
        "Keywords": nth("user_id", "'Sea, sky'", """'["b","a"]'""", "''"),
        "ProjectionType": nth("event_id", "'Equirectangular'", "''", "'cubestrip'"),
        "CompressorID": nth("user_id", "'HVC1'", "'x-jpeg'", "'A_AAC'", "'odd'"),
        "DocumentID": nth("event_id", "'0F7AC9B2-1111-2222-3333-ABCDEF012345'", "'xmp.did:1'", "'0'"),
        "ImageWidth": nth("user_id", u, "'0'", "'640 px'"), "ImageHeight": nth("event_id", "'480'", k),
        "PixelXDimension": u, "Orientation": nth("user_id", "'Rotate 90 CW'", "'Unknown (0)'", "'8'"),
        "Rotation": nth("event_id", "'90'", "'180'", "'7'"), "ISO": nth("user_id", "'3000000000'", "'1E2'", u),
        "FNumber": nth("event_id", "'0.00012'", "'12345678.5'", "'2.8'"),
        "FlashFired": nth("user_id", "'2'", "'True'", "'0'", "'no'"),
        "Duration": nth("event_id", "'2.41 s'", "'0:01:05'", "'1.5E1'"), "Make": "' Kodak '",
    }
    m = "MAP {" + ", ".join(f"'{t}': {v}" for t, v in tags.items()) + "}"

    def field(f):
        names, kind = _TG.TAG_FIELDS[f]
        return convert_sql(first_tag_sql("m", names), kind)

    def tag(t):
        return f"map_extract_value(m, '{t}')"

    def tag_int(t):
        return (f"CASE WHEN regexp_matches({tag(t)}, '^[+\\-]?[0-9]+(\\.[0-9]*)?$') "
                f"THEN TRY_CAST(trunc(TRY_CAST({tag(t)} AS DOUBLE)) AS INTEGER) END")
    pos = first_tag_sql("m", ["GPSPosition"])
    la, lo = first_tag_sql("m", ["GPSLatitude"]), first_tag_sql("m", ["GPSLongitude"])

    def arrays(e):
        return (f"regexp_extract_all({e}, '{_FLOAT_RE}') AS fl, regexp_extract_all({e}, '[0-9\\.]+') AS co, "
                f"regexp_extract_all({e}, '[NSEW]+') AS re")

    def decimal(a, t):
        return (f"CAST(CASE WHEN {t} = '' THEN 0.0 WHEN regexp_matches({t}, "
                f"'^[+\\-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+\\-]?[0-9]+)?$') THEN TRY_CAST({t} AS DOUBLE) "
                f"WHEN len({a}.co) = 3 AND len({a}.re) = 1 THEN {_dms_sql(a + '.co', 1, a + '.re[1]')} ELSE 0.0 END AS FLOAT)")

    def pair(a, i):
        return (f"CAST(CASE WHEN len({a}.fl) = 2 AND TRY_CAST({a}.fl[1] AS DOUBLE) IS NOT NULL "
                f"AND TRY_CAST({a}.fl[2] AS DOUBLE) IS NOT NULL THEN CAST({a}.fl[{i}] AS DOUBLE) "
                f"WHEN len({a}.co) = 6 AND len({a}.re) = 2 THEN {_dms_sql(a + '.co', 3 * i - 2, a + f'.re[{i}]')} "
                f"ELSE 0.0 END AS FLOAT)")

    def structs(e):
        return (f"{{'fl': regexp_extract_all({e}, '{_FLOAT_RE}'), 'co': regexp_extract_all({e}, '[0-9\\.]+'), "
                f"'re': regexp_extract_all({e}, '[NSEW]+')}}")
    times = {n: tag_datetime_sql(n + "_t") for n in ("taken", "created", "gps")}
    steps = _resolve_sql().split("s1 AS", 1)[1].rsplit("SELECT event_id", 1)[0].rstrip()
    pattern = _D.TAG_DATETIME_PATTERN
    frac = f"regexp_extract(coalesce(taken_t, ''), '{pattern}', 7)"
    micros = (f"(CASE WHEN {times['taken']['utc']} IS NOT NULL AND {frac} <> '' "
              f"THEN CAST(rpad(substr({frac}, 1, 6), 6, '0') AS INTEGER) ELSE 0 END)")
    layouts = ", ".join(f"'{x}'" for x in _D.REFERENCE_OFFSET_LAYOUTS)
    day = "(CAST(floor(ta / 86400) AS BIGINT) * 86400)"
    shift = f"({day} - {instant_sql(day, chr(39) + 'Asia/Chongqing' + chr(39))})"
    birth = (f"CASE WHEN year(make_timestamp(ta * 1000000)) > 1900 THEN CASE WHEN tz <> '' OR coalesce(off_text, '') IN "
             f"({layouts}) OR coalesce(off_text, '') <> '' THEN ta ELSE ta - {shift} END END")
    desc = convert_sql(first_tag_sql("m", _TG.TAG_FIELDS["description"][0]), "string")
    codec = f"lower(coalesce({field('codec')}, ''))"
    auto = f"CASE WHEN coalesce({desc}, '') <> '' THEN {_AUTO.format(g11(desc))} ELSE [] END"
    words = (f"regexp_extract_all(lower({g11(first_tag_sql('m', ['Keywords']))}), '{_X.WORD_PATTERN}')")
    pano = f"CASE WHEN lower({field('projection')}) = 'equirectangular' THEN ['panorama'] ELSE [] END"
    doc = f"lower(trim({field('document_id')}))"
    sub = tag("SubSecTimeOriginal")
    both = f"CASE WHEN {tag('ImageWidth')} IS NOT NULL AND {tag('ImageHeight')} IS NOT NULL THEN"
    fl1 = f"regexp_extract_all({tag('GPSAltitude')}, '{_FLOAT_RE}')"
    return f"""
WITH src AS (SELECT t.*, p.position, p.lat_text, ev.user_id FROM ({EVENTS_TIME_TAGS}) t
             JOIN ({EVENTS_POSITION_TEXT}) p USING (event_id) JOIN events ev USING (event_id)),
mm AS (SELECT event_id, {m} AS m FROM src),
f0 AS (SELECT event_id, m, {first_tag_sql('m', _TG.TAG_FIELDS['taken_at'][0])} AS taken_t,
              {first_tag_sql('m', _TG.TAG_FIELDS['created_at'][0])} AS created_t,
              {first_tag_sql('m', _TG.TAG_FIELDS['taken_gps'][0])} AS gps_t,
              coalesce(trim({pos}), '') AS pos_t, coalesce(trim({la}), '') AS la_t, coalesce(trim({lo}), '') AS lo_t FROM mm),
f1 AS (SELECT *, {structs('pos_t')} AS pa, {structs('la_t')} AS laa, {structs('lo_t')} AS loa FROM f0),
f2 AS (SELECT *, CASE WHEN pos_t <> '' THEN {pair('pa', 1)} WHEN la_t <> '' AND lo_t <> '' THEN {decimal('laa', 'la_t')}
                      ELSE CAST(0 AS FLOAT) END AS lat,
              CASE WHEN pos_t <> '' THEN {pair('pa', 2)} WHEN la_t <> '' AND lo_t <> '' THEN {decimal('loa', 'lo_t')}
                      ELSE CAST(0 AS FLOAT) END AS lng FROM f1),
zz AS (SELECT p.event_id, arg_min(b.zone, {{'p': b.priority, 'z': b.zone}}) AS zone FROM f2 p JOIN ({NATION_BOXES}) b
         ON CAST(p.lat AS DOUBLE) >= b.lat_min AND CAST(p.lat AS DOUBLE) < b.lat_max
        AND CAST(p.lng AS DOUBLE) >= b.lng_min AND CAST(p.lng AS DOUBLE) < b.lng_max
       WHERE p.lat <> 0 AND p.lng <> 0 GROUP BY p.event_id),
s0 AS (SELECT f2.*, zz.zone, {tag('MIMEType')} AS mime, coalesce(lat <> 0 AND lng <> 0, false) AS pos,
              CASE WHEN {times['taken']['utc']} IS NOT NULL THEN regexp_extract(coalesce(taken_t, ''), '{pattern}', 8) END
                AS off_text,
              {times['taken']['utc']} AS ta, {times['taken']['local']} AS ta_wall, coalesce({times['taken']['offset']}, 0) AS ta_off,
              {times['taken']['utc']} AS tl, {times['taken']['local']} AS tl_wall, coalesce({times['taken']['offset']}, 0) AS tl_off,
              '' AS tz, {times['created']['utc']} AS c_utc, {times['created']['local']} AS c_wall,
              {times['created']['offset']} AS c_off, {times['gps']['utc']} AS g_utc
       FROM f2 LEFT JOIN zz USING (event_id)),
s1 AS{steps}
SELECT event_id, {g9(field('title'))} AS title, {g11(field('subject'))} AS subject, {g11(field('artist'))} AS artist,
       {g10(desc)} AS description,
       array_to_string(list_sort(list_distinct(list_concat(list_concat({words}, {pano}), {auto}))), ', ') AS keywords,
       CASE WHEN contains({codec}, 'jpeg') THEN 'jpeg' WHEN (CASE {codec} {_VC} END) IS NOT NULL THEN (CASE {codec} {_VC} END)
            WHEN starts_with({codec}, 'a_') THEN '' ELSE {codec} END AS codec,
       CASE WHEN regexp_matches({doc}, '{_UUID}') THEN {doc} ELSE '' END AS document_id, lat, lng,
       coalesce({field('altitude')}, CASE WHEN len({fl1}) = 1 THEN TRY_CAST(trunc(TRY_CAST({fl1}[1] AS DOUBLE)) AS BIGINT)
                ELSE 0 END) AS altitude,
       coalesce({both} CASE WHEN {tag_int('ImageWidth')} > 0 THEN {tag_int('ImageWidth')} END END, {field('width')}) AS width,
       coalesce({both} CASE WHEN {tag_int('ImageHeight')} > 0 THEN {tag_int('ImageHeight')} END END, {field('height')}) AS height,
       {orientation_sql(tag('Orientation'), field('rotation'))} AS orientation, {field('iso')} AS iso,
       {field('f_number')} AS f_number, coalesce({field('flash')}, false) AS flash, {field('duration')} AS duration,
       {field('camera_make')} AS camera_make, ta AS taken_utc, tl_wall AS taken_local, tz AS time_zone,
       CAST(CASE WHEN regexp_matches({sub}, '^[0-9]+$') AND length({sub}) <= 9 AND TRY_CAST({sub} AS BIGINT) > 0
                 THEN TRY_CAST(rpad({sub}, 9, '0') AS INTEGER) ELSE {micros} * 1000 END AS BIGINT) AS taken_ns,
       {birth} AS birth
FROM s12
"""


ORACLE["normalize_tags"] = _normalize_sql()


# -- summaries and the metadata cache ------------------------------------------------------

_LOCAL = "timezone('Asia/Shanghai', to_timestamp(timeborn))"
ORACLE["catalog_summary"] = f"""
WITH f AS ({DOC_FILES}),
p AS (SELECT mimetype, year({_LOCAL}) AS year, month({_LOCAL}) AS month, id, count(*) AS n, min(size) AS size,
             sum(size) AS bytes
      FROM f GROUP BY ALL)
SELECT mimetype, year, month, CAST(sum(n) AS BIGINT) AS files, count(*) AS contents, CAST(sum(bytes) AS BIGINT) AS bytes,
       CAST(sum((n - 1) * size) AS BIGINT) AS duplicate_bytes
FROM p GROUP BY mimetype, year, month
"""

ORACLE["action_counts"] = f"WITH {BACKUP_PLAN_CTES} SELECT action, count(*) AS n FROM plan GROUP BY action"

ORACLE["cache_join"] = f"""
WITH f AS ({DOC_FILES}),
cache AS (SELECT {md5_id('text')} AS id, min('{{"FileName": "' || CAST(doc_id AS VARCHAR) || '.txt"}}') AS json
          FROM documents WHERE lang = 'en' GROUP BY 1),
meta AS (SELECT id, min(CASE WHEN timebornsrc = 'meta' THEN timeborn END) AS taken_utc FROM f GROUP BY id),
ids AS (SELECT DISTINCT id FROM f)
SELECT {id_hex('ids.id')} AS id_hex, CASE WHEN cache.json IS NOT NULL THEN 'cached' ELSE 'extract' END AS status,
       {id_hex('ids.id')} || '_exiftool.json' AS cache_name, meta.taken_utc,
       (cache.json IS NULL AND coalesce(year(make_timestamp(meta.taken_utc * 1000000)) > 1900, false)) AS write_cache
FROM ids LEFT JOIN cache ON ids.id = cache.id JOIN meta ON meta.id = ids.id
"""


# -- content types and merged sources ------------------------------------------------------

def _mime_sql(fallback: bool) -> str:
    from mediafold.operators.mime import EBML, SIGNATURES
    from mediafold.plans.queries import PAGE_HEADERS

    def part(off, h):
        return f"substr(hx, {off * 2 + 1}, {len(h)}) = '{h.upper()}'"
    whens = " ".join(
        f"WHEN {' OR '.join('(' + ' AND '.join(part(o, h) for o, h in p) + ')' for p in alts)} THEN '{t}/{s}'"
        for t, s, alts in SIGNATURES)
    ebml = part(*EBML)
    whens += (f" WHEN {ebml} AND contains(substr(hx, 1, 8192), '4282847765626D') THEN 'video/webm'"
              f" WHEN {ebml} AND contains(substr(hx, 1, 8192), '4282886D6174726F736B61') THEN 'video/x-matroska'"
              f" WHEN {ebml} THEN 'video/webm'")
    heads = " ".join(f"WHEN page_id % 8 = {k} THEN '{h.upper()}'" for k, h in PAGE_HEADERS.items())
    stated = ("CASE WHEN contains(url, '?page=') THEN 'audio/x-stated' WHEN page_id % 3 = 0 THEN 'video/mp4; x' "
              "WHEN page_id % 3 = 1 THEN 'oddity' END")
    mt, ms = "split_part(m, '/', 1)", "substr(m, strpos(m, '/') + 1)"
    if fallback:
        mt = f"CASE WHEN m IS NOT NULL THEN {mt} ELSE nullif(split_part(stated, '/', 1), '') END"
        ms = (f"CASE WHEN m IS NOT NULL THEN {ms} WHEN strpos(stated, '/') > 0 "
              f"THEN substr(stated, strpos(stated, '/') + 1) END")
    return f"""
WITH c AS (
  SELECT page_id, {stated} AS stated,
         CASE {heads} WHEN starts_with(url, 'https://m.') THEN 'FFD8FFE0'
              WHEN contains(url, '.example.org/') THEN '0000001866747970'
              WHEN starts_with(url, 'http://') THEN '89504E470D0A1A0A' ELSE '' END
         || hex(encode(left(html, 300))) AS hx
  FROM pages),
d AS (SELECT page_id, stated, CASE {whens} END AS m FROM c),
t AS (SELECT page_id, {mt} AS mimetype, {ms} AS mimesubtype FROM d)
SELECT page_id, mimetype, mimesubtype, coalesce(mimetype IN ('video', 'audio', 'image'), false) AS backed_up FROM t
"""


ORACLE["mime_signatures"] = _mime_sql(False)
ORACLE["classify_media"] = _mime_sql(True)


def _nz(e: str) -> str:
    return f"CASE WHEN trim({e}) <> '' THEN {e} END"


ORACLE["merge_sources"] = f"""
WITH e AS (SELECT doc_id, 'Doc ' || CAST(doc_id AS VARCHAR) AS title, source AS make,
                  CASE WHEN lang = 'en' THEN '' ELSE lang END AS description FROM documents),
j AS (SELECT doc_id, 'Label ' || CAST(doc_id AS VARCHAR) AS title, 'lang-' || CAST(quality AS VARCHAR) AS description,
             CAST(quality AS VARCHAR) AS rating FROM labels),
x AS (SELECT doc_id, 'Flagged ' || CAST(doc_id AS VARCHAR) AS title, '' AS make FROM labels WHERE toxic = 1),
k AS (SELECT doc_id FROM e UNION SELECT doc_id FROM j UNION SELECT doc_id FROM x)
SELECT k.doc_id,
       coalesce({_nz('x.title')}, {_nz('e.title')}, {_nz('j.title')}) AS title,
       coalesce({_nz('x.make')}, {_nz('e.make')}) AS make,
       coalesce({_nz('e.description')}, {_nz('j.description')}) AS description,
       {_nz('j.rating')} AS rating,
       concat_ws(',', CASE WHEN e.doc_id IS NOT NULL THEN 'exif' END, CASE WHEN j.doc_id IS NOT NULL THEN 'json' END,
                 CASE WHEN x.doc_id IS NOT NULL THEN 'xmp' END) AS sources
FROM k LEFT JOIN e ON e.doc_id = k.doc_id LEFT JOIN j ON j.doc_id = k.doc_id LEFT JOIN x ON x.doc_id = k.doc_id
"""


# -- sidecars ---------------------------------------------------------------------------

def _json_str_sql(e: str) -> str:
    return (f"replace(replace(replace(replace(replace({e}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), "
            f"chr(13), '\\r'), chr(9), '\\t')")


_T = _json_str_sql("text")
CONVERSATION_SIDECARS = f"""
  SELECT conv_id, turn, CASE
    WHEN conv_id % 5 = 0 THEN '[{{"ExifToolVersion": 12.4, "Title": "' || {_T} || '"}}]'
    WHEN role = 'user' THEN '{{"title": "' || {_T} || '", "description": "' || role || '", "imageViews": "'
         || CAST(turn * 3 AS VARCHAR) || '", "photoTakenTime": {{"timestamp": "'
         || CAST(1600000000 + conv_id * 86400 + turn * 3600 AS VARCHAR) || '", "formatted": ""}}, "geoData": {{"latitude": '
         || CASE WHEN turn % 3 = 0 THEN '0.0' ELSE CAST((conv_id % 170) - 85 AS VARCHAR) END || ', "longitude": '
         || CAST((conv_id * 7 % 360) - 180 AS VARCHAR) || ', "altitude": ' || CAST(turn * 10 AS VARCHAR) || '.75}}}}'
    WHEN role = 'assistant' THEN '{{"albumData": {{"title": "' || CASE WHEN turn % 4 = 1 THEN '' ELSE {_T} END
         || '", "description": ""}}}}'
    ELSE '{{"unknown": 1}}' END AS doc
  FROM conversations
"""

_PHOTO = ("json_transform(doc, '{\"title\": \"VARCHAR\", \"description\": \"VARCHAR\", \"imageViews\": \"VARCHAR\", "
          "\"photoTakenTime\": {\"timestamp\": \"VARCHAR\"}, \"geoData\": {\"latitude\": \"DOUBLE\", "
          "\"longitude\": \"DOUBLE\", \"altitude\": \"DOUBLE\"}}')")
ORACLE["sidecar_kinds"] = f"""
WITH s AS (SELECT *, CASE WHEN contains(doc, 'ExifToolVersion') THEN 'exiftool' WHEN contains(doc, 'albumData') THEN 'album'
                          WHEN contains(doc, 'photoTakenTime') THEN 'photo' ELSE 'unknown' END AS kind
           FROM ({CONVERSATION_SIDECARS})),
p AS (SELECT *, CASE WHEN kind = 'photo' THEN {_PHOTO} END AS j,
             CASE WHEN kind = 'album' THEN json_extract_string(doc, '$.albumData.title') END AS atitle FROM s),
q AS (SELECT *, {g9('j.title')} AS st, {g10('j.description')} AS sd,
             CASE WHEN regexp_matches(j.imageViews, '^[0-9]+$') THEN TRY_CAST(j.imageViews AS INTEGER) END AS v,
             CASE WHEN regexp_matches(coalesce(struct_extract(j.photoTakenTime, 'timestamp'), ''), '^[0-9]+$')
                  THEN TRY_CAST(struct_extract(j.photoTakenTime, 'timestamp') AS BIGINT) END AS ep,
             coalesce(j.geoData.latitude <> 0 AND j.geoData.longitude <> 0, false) AS hp
      FROM p)
SELECT conv_id, turn, kind,
       CASE WHEN kind = 'photo' AND st <> '' THEN st END AS title,
       CASE WHEN kind = 'photo' AND sd <> '' THEN sd END AS description,
       CASE WHEN kind = 'photo' AND v > 0 THEN v END AS views,
       CASE WHEN kind = 'photo' AND ep > 0 THEN ep END AS taken_utc,
       CASE WHEN kind = 'photo' AND hp THEN CAST(j.geoData.latitude AS FLOAT) END AS lat,
       CASE WHEN kind = 'photo' AND hp THEN CAST(j.geoData.longitude AS FLOAT) END AS lng,
       CASE WHEN kind = 'photo' AND hp THEN TRY_CAST(trunc(j.geoData.altitude) AS INTEGER) END AS altitude,
       CASE WHEN kind = 'album' AND trim(coalesce(atitle, '')) <> '' THEN atitle END AS album
FROM q
"""


_SIDE = f"""s AS (SELECT *, CASE WHEN contains(doc, 'ExifToolVersion') THEN 'exiftool' WHEN contains(doc, 'albumData') THEN 'album'
                          WHEN contains(doc, 'photoTakenTime') THEN 'photo' ELSE 'unknown' END AS kind
           FROM ({CONVERSATION_SIDECARS}))"""
ORACLE["photo_zones"] = f"""
WITH {_SIDE},
p AS (SELECT *, CASE WHEN kind = 'photo' THEN {_PHOTO} END AS j FROM s),
q AS (SELECT conv_id, turn, CAST(j.geoData.latitude AS FLOAT) AS lat, CAST(j.geoData.longitude AS FLOAT) AS lng,
             CASE WHEN regexp_matches(coalesce(struct_extract(j.photoTakenTime, 'timestamp'), ''), '^[0-9]+$')
                   AND TRY_CAST(struct_extract(j.photoTakenTime, 'timestamp') AS BIGINT) > 0
                  THEN TRY_CAST(struct_extract(j.photoTakenTime, 'timestamp') AS BIGINT) END AS ep FROM p),
z AS (SELECT q.conv_id, q.turn, arg_min(b.zone, {{'p': b.priority, 'z': b.zone}}) AS zone FROM q JOIN ({NATION_BOXES}) b
        ON CAST(q.lat AS DOUBLE) >= b.lat_min AND CAST(q.lat AS DOUBLE) < b.lat_max
       AND CAST(q.lng AS DOUBLE) >= b.lng_min AND CAST(q.lng AS DOUBLE) < b.lng_max
      WHERE q.lat <> 0 AND q.lng <> 0 GROUP BY ALL)
SELECT q.conv_id, q.turn, CASE WHEN z.zone IS NULL THEN ep ELSE {instant_sql('ep', 'z.zone')} END AS taken_utc,
       ep AS taken_local, coalesce(z.zone, '') AS time_zone
FROM q LEFT JOIN z ON z.conv_id = q.conv_id AND z.turn = q.turn
"""
ORACLE["album_titles"] = f"""
WITH {_SIDE},
a AS (SELECT '/albums/' || CAST(CAST(floor(conv_id / 10) AS BIGINT) AS VARCHAR) AS directory,
             json_extract_string(doc, '$.albumData.title') AS title FROM s WHERE kind = 'album')
SELECT directory, title, count(*) AS n_sidecars FROM a WHERE trim(coalesce(title, '')) <> '' GROUP BY ALL
"""
ORACLE["name_check"] = """
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN 'IMG_' || CAST(o_orderkey AS VARCHAR) || '.jpg' END AS want,
                  CASE o_orderstatus WHEN 'O' THEN 'IMG_' || CAST(o_orderkey AS VARCHAR) || '.jpg'
                       WHEN 'F' THEN 'IMG_' || CAST(o_orderkey + o_custkey % 2 AS VARCHAR) || '.jpg' ELSE '' END AS got
           FROM orders)
SELECT o_orderkey, CASE WHEN got <> '' AND coalesce(want, '') <> '' AND got <> want
                        THEN 'original name ' || want || ' does not match ' || got END AS error
FROM o
"""


# -- taken dates -------------------------------------------------------------------------------

def _xmp_sql(v: str) -> str:
    rfc = "^(\\d{4})-(\\d{2})-(\\d{2})T(\\d{2}):(\\d{2}):(\\d{2})(?:\\.(\\d+))?(Z|[+\\-]\\d{2}:\\d{2})$"
    loc = "^(\\d{4})-(\\d{2})-(\\d{2})T(\\d{2}):(\\d{2}):(\\d{2})(?:\\.(\\d+))?$"
    t = f"trim(coalesce({v}, ''))"
    as_tag = f"regexp_replace({t}, '^(\\d{{4}})-(\\d{{2}})-(\\d{{2}})T', '\\1:\\2:\\3 ')"
    full = tag_datetime_sql(f"(CASE WHEN regexp_matches({t}, '{rfc}') OR regexp_matches({t}, '{loc}') THEN {as_tag} END)")
    f19 = tag_datetime_sql(f"regexp_replace(substr({t}, 1, 19), '^(\\d{{4}})-(\\d{{2}})-(\\d{{2}})T', '\\1:\\2:\\3 ')")
    return f"coalesce({full['utc']}, {f19['utc']})"


def _exif_taken_sql(texts: list[str], gps: str, zone: str) -> str:
    vals = []
    for t in texts:
        d = tag_datetime_sql(t)
        in_zone = f"CASE WHEN coalesce({zone}, '') = '' THEN {d['utc']} ELSE {instant_sql(d['local'], zone)} END"
        vals.append(f"CASE WHEN {d['offset']} IS NOT NULL THEN {d['utc']} ELSE {in_zone} END")
    return f"coalesce({', '.join(vals)}, {gps})"


def _taken_dates_sql() -> str:
    exif = _exif_taken_sql(["dto", "CAST(NULL AS VARCHAR)", "cdt"], "gps", "zone")
    day = "(CAST(floor(exif_utc / 86400) AS BIGINT) * 86400)"
    shift = f"({day} - {instant_sql(day, "'Asia/Chongqing'")})"
    birth = (f"CASE WHEN year(make_timestamp(exif_utc * 1000000)) > 1900 THEN "
             f"CASE WHEN coalesce(zone, '') <> '' THEN exif_utc ELSE exif_utc - {shift} END END")
    return f"""
WITH z AS (SELECT event_id, zone FROM ({ZONED_POINTS})),
x AS (
  SELECT e.event_id, z.zone, e.event_type,
    CASE e.event_type WHEN 'view' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+01:00'
         WHEN 'click' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') WHEN 'purchase' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'
         WHEN 'error' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' extra' ELSE 'garbage' END AS xmp_text,
    CASE WHEN e.event_type = 'view' THEN strftime(ts, '%Y:%m:%d %H:%M:%S') END AS dto,
    CASE WHEN e.event_type IN ('click', 'error') THEN strftime(ts, '%Y:%m:%d %H:%M:%S') END AS cdt,
    CASE WHEN e.event_type = 'purchase' THEN CAST(floor(epoch(ts)) AS BIGINT) - 60 END AS gps,
    CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) AS epoch_text
  FROM events e JOIN z ON e.event_id = z.event_id),
y AS (
  SELECT event_id, zone, {_xmp_sql('xmp_text')} AS xmp_utc,
    CASE WHEN ep > 0 THEN CASE WHEN coalesce(pz, '') = '' THEN ep ELSE {instant_sql('ep', 'pz')} END END AS photo_utc,
    {exif} AS exif_utc
  FROM (SELECT *, CASE WHEN regexp_matches(epoch_text, '^[0-9]+$') THEN TRY_CAST(epoch_text AS BIGINT) END AS ep,
               CASE WHEN event_type = 'click' THEN zone END AS pz FROM x))
SELECT event_id, xmp_utc, photo_utc, exif_utc, {birth} AS birth,
       CASE WHEN ({birth}) IS NOT NULL THEN 'meta' END AS birth_src
FROM y
"""


ORACLE["taken_dates"] = _taken_dates_sql()


# -- streams ---------------------------------------------------------------------------------

def _exif_metadata_sql() -> str:
    k, u = "event_id", "user_id"
    dms = "(d + m / 60.0 + s / 3600.0)"
    box = (f"SELECT p.event_id, arg_min(b.zone, {{'p': b.priority, 'z': b.zone}}) AS zone FROM g p JOIN ({NATION_BOXES}) b "
           "ON CAST(p.lat AS DOUBLE) >= b.lat_min AND CAST(p.lat AS DOUBLE) < b.lat_max "
           "AND CAST(p.lng AS DOUBLE) >= b.lng_min AND CAST(p.lng AS DOUBLE) < b.lng_max "
           "WHERE p.lat <> 0 AND p.lng <> 0 GROUP BY p.event_id")
    tag = "strftime(ts, '%Y:%m:%d %H:%M:%S')"
    texts = [f"(CASE WHEN event_type = 'view' THEN {tag} END)",
             f"(CASE WHEN event_type = 'click' THEN {tag} || '+02:00' END)", f"({tag})"]
    local = "coalesce(" + ", ".join(tag_datetime_sql(t)["local"] for t in texts) + ")"
    return f"""
WITH r AS (SELECT *, {k} % 80 AS d, {u} % 60 AS m, ({k} % 6000) / 100.0 AS s, {k} % 170 AS ld FROM events),
g AS (SELECT *, CASE WHEN {k} % 9 <> 0 THEN CAST(CASE WHEN {u} % 2 = 0 THEN -{dms} ELSE {dms} END AS FLOAT) END AS lat,
             CASE WHEN {k} % 9 <> 0 THEN CAST(CASE WHEN {k} % 3 = 0 THEN -(ld + m / 60.0) ELSE ld + m / 60.0 END AS FLOAT)
                  END AS lng,
             CAST(trunc((CASE WHEN {u} % 2 = 1 THEN -1 ELSE 1 END) * ({k} % 5000) / 10.0) AS INTEGER) AS alt FROM r),
z AS ({box}),
t AS (SELECT g.*, z.zone,
             CAST(epoch(date_trunc('day', ts)) AS BIGINT) + ({k} % 24) * 3600 + ({u} % 60) * 60 + 29 AS gps_utc
      FROM g LEFT JOIN z USING (event_id))
SELECT CAST({k} AS VARCHAR) AS path, 'Kodak' AS camera_make, lat, lng, CASE WHEN alt <> 0 THEN alt END AS altitude,
       coalesce(zone, '') AS time_zone, gps_utc, {_exif_taken_sql(texts, 'gps_utc', 'zone')} AS taken_utc,
       coalesce({local}, gps_utc) AS taken_local,
       CASE WHEN {k} % 90 > 0 THEN CAST(rpad(CAST({k} % 90 AS VARCHAR), 9, '0') AS INTEGER) ELSE 0 END AS taken_ns
FROM t
"""


ORACLE["exif_metadata"] = _exif_metadata_sql()

ORACLE["stream_index"] = f"""
WITH r AS (
  SELECT '/stream/' || event_type || '/' || CAST(user_id AS VARCHAR) || '.evt' AS name,
         'user' || CAST(user_id % 8 AS VARCHAR) AS hostname,
         {md5_id("event_type || ':' || CAST(user_id AS VARCHAR)")} AS id,
         CAST(floor(value * 100) AS BIGINT) AS size, CAST(floor(epoch(ts)) AS BIGINT) AS timemodified
  FROM events)
SELECT name, hostname, any_value(id) AS id, arg_max(size, {{'t': timemodified, 's': size}}) AS size,
       max(timemodified) AS timemodified, max(timemodified) AS timeborn, 'stat' AS timebornsrc,
       'application' AS mimetype, 'octet-stream' AS mimesubtype
FROM r GROUP BY name, hostname
"""

ORACLE["stream_dedupe"] = f"""
SELECT DISTINCT substr(md5(event_type || ':' || CAST(user_id AS VARCHAR)), 1, 16) AS id_hex FROM events
"""

ORACLE["alternate_names"] = f"""
WITH f AS ({DOC_FILES}),
pairs AS (SELECT id, string_split(name, '/')[-1] AS basename, count(*) AS n_files FROM f GROUP BY 1, 2),
multi AS (SELECT id FROM pairs GROUP BY id HAVING count(*) > 1)
SELECT {id_hex('p.id')} AS id_hex, p.basename, p.n_files FROM pairs p JOIN multi m ON p.id = m.id
"""


def _image_sizes_sql() -> str:
    w, h = "CAST(p_size * 40 AS VARCHAR)", "CAST(p_partkey % 50 * 30 AS VARCHAR)"
    doc = (f"CASE WHEN p_type = 'ECONOMY' THEN '{{\"ImageWidth\": ' || {w} || ', \"ImageHeight\": ' || {h} "
           f"|| ', \"ExifImageWidth\": 11, \"ExifImageHeight\": 22}}' "
           f"WHEN p_type = 'SMALL' THEN '{{\"ImageWidth\": ' || {w} || ', \"ExifImageHeight\": 22}}' "
           f"ELSE '{{\"PixelXDimension\": \"' || {w} || '\", \"ImageLength\": \"' || {h} "
           f"|| '\", \"ImageWidth\": \"0\", \"ImageHeight\": \"' || {h} || '\"}}' END")
    sel = []
    for f in ("width", "height"):
        names, kind = _TG.TAG_FIELDS[f]
        sel.append(f"{convert_sql(first_tag_sql('m', names), kind)} AS {f}")
    iw, ih = "map_extract_value(m, 'ImageWidth')", "map_extract_value(m, 'ImageHeight')"

    def tag_int(v):
        return f"CASE WHEN regexp_matches({v}, '^[+\\-]?[0-9]+(\\.[0-9]*)?$') THEN TRY_CAST(trunc(TRY_CAST({v} AS DOUBLE)) AS INTEGER) END"
    both = f"({iw} IS NOT NULL AND {ih} IS NOT NULL)"
    return f"""
WITH d AS (SELECT p_partkey, {doc} AS doc FROM part),
p AS (SELECT p_partkey, json_transform('[' || doc || ']', '["MAP(VARCHAR, VARCHAR)"]')[1] AS m FROM d),
a AS (SELECT p_partkey, m, {', '.join(sel)} FROM p)
SELECT p_partkey,
       CASE WHEN {both} AND {tag_int(iw)} > 0 THEN {tag_int(iw)} ELSE width END AS width,
       CASE WHEN {both} AND {tag_int(ih)} > 0 THEN {tag_int(ih)} ELSE height END AS height
FROM a
"""


ORACLE["image_sizes"] = _image_sizes_sql()


# -- place cells ----------------------------------------------------------------------------

def _cell_sql() -> str:
    """The curve walked bit by bit: four positions an orientation, so unlike the table of the library."""
    from mediafold.functions import cells
    order = "[" + ", ".join(str(x) for row in cells.IJ_TO_POS for x in row) + "]"
    turn = "[" + ", ".join(str(x) for x in cells.POS_TO_ORIENTATION) + "]"
    n = 1 << cells.MAX_LEVEL

    def number(w: str) -> str:
        s = f"CASE WHEN {w} >= 0 THEN 0.5 * sqrt(1 + 3 * abs({w})) ELSE 1 - 0.5 * sqrt(1 + 3 * abs({w})) END"
        return f"CAST(least(greatest(floor(({s}) * {n}), 0), {n - 1}) AS BIGINT)"
    steps = []
    for level in range(1, cells.CELL_LEVEL + 1):
        bit = cells.MAX_LEVEL - level
        at = f"{order}[o * 4 + ((i >> {bit}) & 1) * 2 + ((j >> {bit}) & 1) + 1]"
        steps.append(f"w{level} AS (SELECT event_id, face, i, j, pos * 4 + q AS pos, xor(o, {turn}[q + 1]) AS o "
                     f"FROM (SELECT *, {at} AS q FROM w{level - 1}))")
    token = "'s2:' || rtrim(lpad(lower(printf('%x', {})), {}, '0'), '0')"
    cell = token.format("face * 35184372088832 + pos * 8 + 4", 12)  # 3 + 42 + 1 bits and two zeros
    area = token.format("face * 131072 + (pos >> 26) * 2 + 1", 5)  # 3 + 16 + 1 bits
    return f"""
WITH p AS (SELECT event_id, radians(CAST(lat AS DOUBLE)) AS a, radians(CAST(lng AS DOUBLE)) AS b FROM ({EVENT_POINTS})
           WHERE lat <> 0 AND lng <> 0),
xyz AS (SELECT event_id, cos(a) * cos(b) AS x, cos(a) * sin(b) AS y, sin(a) AS z FROM p),
f AS (SELECT *, CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN CASE WHEN x < 0 THEN 3 ELSE 0 END
                     WHEN abs(y) >= abs(z) THEN CASE WHEN y < 0 THEN 4 ELSE 1 END
                     ELSE CASE WHEN z < 0 THEN 5 ELSE 2 END END AS face FROM xyz),
uv AS (SELECT event_id, face,
         CASE face WHEN 0 THEN y / x WHEN 1 THEN -x / y WHEN 2 THEN -x / z WHEN 3 THEN z / x WHEN 4 THEN z / y ELSE -y / z END AS u,
         CASE face WHEN 0 THEN z / x WHEN 1 THEN z / y WHEN 2 THEN -y / z WHEN 3 THEN y / x WHEN 4 THEN -x / y ELSE -x / z END AS v
       FROM f),
w0 AS (SELECT event_id, face, {number('u')} AS i, {number('v')} AS j, CAST(0 AS BIGINT) AS pos, face % 2 AS o FROM uv),
{", ".join(steps)},
c AS (SELECT {cell} AS cell, {area} AS area, count(*) AS n_points, min(event_id) AS first_event
      FROM w{cells.CELL_LEVEL} GROUP BY ALL)
SELECT cell, n_points, first_event, area, CAST(sum(n_points) OVER (PARTITION BY area) AS BIGINT) AS n_area FROM c
"""


ORACLE["cell_rollup"] = _cell_sql()


ORACLE["xmp_records"] = """
SELECT doc_id,
  CASE WHEN bad THEN '' WHEN k % 4 = 0 THEN 'Last word ' || k WHEN k % 3 = 0 THEN 'Bare & ' || k || ' title'
       ELSE 'Walk <' || k || '> home' END AS title,
  CASE WHEN bad THEN '' ELSE 'Jo ' || source END AS artist,
  CASE WHEN bad THEN '' ELSE 'Lang ' || lang || ', sea' END AS subject,
  CASE WHEN bad THEN '' WHEN lang < 'lang' THEN lang || ', lang, sea' WHEN lang < 'sea' THEN 'lang, ' || lang || ', sea'
       ELSE 'lang, sea, ' || lang END AS keywords,
  CASE WHEN bad THEN '' ELSE 'R' END AS copyright, CASE WHEN bad THEN '' ELSE 'Kodak' END AS camera_make,
  CASE WHEN bad THEN '' ELSE source END AS camera_model,
  CASE WHEN NOT bad THEN CAST(epoch(make_timestamp(2000 + k % 20, k % 9 + 1, 10 + k % 10, k % 10, 30 + k % 6, k % 10)) AS BIGINT)
       - CASE WHEN k % 3 = 1 THEN 9000 ELSE 0 END END AS taken_utc
FROM (SELECT *, doc_id AS k, doc_id % 50 = 7 AS bad FROM documents)
"""


ORACLE["merge_metadata"] = """
WITH m AS (
  SELECT d.doc_id, d.doc_id % 4 AS e_iso, d.n_chars % 3 AS e_width, d.doc_id % 5 = 0 AS e_flash, d.lang, d.doc_id % 3 AS e_fps,
         d.source, l.quality, l.toxic, l.doc_id IS NOT NULL AS has
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT doc_id, CAST(coalesce(nullif(e_iso, 0), nullif(quality * 100, 0)) AS BIGINT) AS iso,
  CAST(CASE WHEN has AND toxic = 1 THEN 640 ELSE coalesce(nullif(e_width, 0), CASE WHEN has THEN nullif(doc_id % 7, 0) END) END AS BIGINT)
    AS width,
  CASE WHEN e_flash OR coalesce(quality = 1, false) THEN true END AS flash,
  array_to_string(list_sort(list_distinct(list_concat(['sea'], [lang], CASE WHEN has THEN ['json'] ELSE [] END,
    CASE WHEN has AND toxic = 1 THEN ['art'] ELSE [] END))), ', ') AS keywords,
  CASE WHEN e_fps <> 0 THEN CAST(e_fps AS DOUBLE) WHEN has THEN CAST(29.97 AS DOUBLE) END AS fps, source AS artist,
  concat_ws(',', 'exif', CASE WHEN has THEN 'json' END, CASE WHEN has AND toxic = 1 THEN 'xmp' END) AS sources
FROM m
"""

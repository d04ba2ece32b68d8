"""The same queries as DuckDB SQL."""

from __future__ import annotations

from tidelog.functions.resp import REPLIES
from tidelog.plans.catalog import BUCKET_CAPACITY, BUCKET_RATE, COMMANDS, FLUSH_BYTES, LINES, LRU_KEYS, LRU_SEGMENT_KEYS, NEWEST_LEVEL0, QUOTED

_LOG = """m AS (SELECT concat('user:', CAST(user_id AS VARCHAR)) AS k, props AS v, event_id AS seq, event_type = 'error' AS del,
    CAST(floor(event_id / 200) AS BIGINT) AS run FROM events)"""
_ORDERS = """o AS (SELECT concat('order:', lpad(CAST(o_orderkey AS VARCHAR), 8, '0')) AS k, o_orderstatus AS v, o_orderkey AS seq, o_orderstatus = 'F' AS del,
    CAST(floor((o_orderkey + {shift}) / 1000) AS BIGINT) AS run FROM orders)"""
_REQUESTS = "requests AS (SELECT c_custkey AS pos, concat('user:', CAST(c_custkey % 300 AS VARCHAR)) AS k FROM customer)"
_COLLAPSE = "d AS (SELECT run, k, v, seq, del FROM m QUALIFY row_number() OVER (PARTITION BY run, k ORDER BY seq DESC) = 1)"
_EARLY = _LOG.replace("FROM events)", "FROM events WHERE event_id < 1000)")
_BYTES = "octet_length(encode({}))"


def _live(source: str = "m", columns: str = "k, v, seq") -> str:
    return f"SELECT {columns} FROM (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1) WHERE NOT del"


def _log(body: str, *more: str) -> str:
    return "WITH " + ", ".join([_LOG, *more]) + " " + body


def _early(body: str, *more: str) -> str:
    return "WITH " + ", ".join([_EARLY, *more]) + " " + body


def _poly(key: str, modulus: int) -> str:
    return f"CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split({key}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) % {modulus} AS INTEGER)"


_WRAP = "18446744073709551616"
_FNV = f"list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS HUGEINT))), lambda h, c: (xor(h, c) * 1099511628211) % {_WRAP})"
_DJB = f"list_reduce(list_prepend(CAST(5381 AS HUGEINT), list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS HUGEINT))), lambda h, c: (h * 33 + c) % {_WRAP})"


def _sizes(segments: int = 1) -> str:
    n = "count(*)" if segments == 1 else f"floor((count(*) + {segments - 1}) / {segments})"
    bits = f"floor({n} * (-ln(0.01) / (ln(2) * ln(2))))"
    return f"""sizes AS (SELECT run, count(*) AS n, CAST(greatest({bits}, 1024) AS BIGINT) AS b_bits,
        CAST(least(greatest(floor({bits} * ln(2) / {n}), 2), 20) AS BIGINT) AS b_hashes FROM d GROUP BY run)"""


_HASHED = f"hashed AS (SELECT k, {_FNV} AS h1, {_DJB} AS h2 FROM (SELECT DISTINCT k FROM m UNION SELECT DISTINCT k FROM requests))"


def _positions(columns: str, source: str = "d") -> str:
    return f"""SELECT DISTINCT {columns}, CAST(((h1 + i * h2) % {_WRAP}) % b_bits AS BIGINT) AS position FROM {source} JOIN sizes USING (run) JOIN hashed USING (k), (SELECT unnest(range(20)) AS i) WHERE i < b_hashes"""


def _text(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _rows(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(str, r)) + ")" for r in rows)


_U32 = 4294967296
_CODES = "list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT))"
_WORD = "list_transform(range(0, len(c) // 4), lambda i: c[4 * i + 1] + c[4 * i + 2] * 256 + c[4 * i + 3] * 65536 + c[4 * i + 4] * 16777216)"


def _times(x: str) -> str:
    return f"CAST((CAST({x} AS HUGEINT) * 1540483477) % {_U32} AS BIGINT)"


def _folded(x: str, shift: int) -> str:
    return f"xor({x}, ({x}) >> {shift})"


def _segment() -> str:
    """The 32-bit multiply-and-shift hash of little-endian words with seed 0, modulo 4, of ASCII keys."""
    word = _times(_folded(_times("w"), 24))
    whole = f"list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform({_WORD}, lambda w: {word})), lambda h, w: xor({_times('h')}, w))"
    rest = "coalesce(c[4 * (len(c) // 4) + 1], 0) + coalesce(c[4 * (len(c) // 4) + 2], 0) * 256 + coalesce(c[4 * (len(c) // 4) + 3], 0) * 65536"
    tail = f"list_transform([xor({whole}, {rest})], lambda h: CASE WHEN len(c) % 4 > 0 THEN {_times('h')} ELSE h END)"
    last = f"list_transform({tail}, lambda h: {_times(_folded('h', 13))})"
    return f"(SELECT CAST({_folded(f'({last})[1]', 15)} % 4 AS INTEGER) FROM (SELECT {_CODES} AS c))"


_SEGMENT = _segment()
_MD5 = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(left(md5(concat(CAST(i AS VARCHAR), ':', k)), 15), ''), lambda c: CAST(instr('0123456789abcdef', c) - 1 AS BIGINT))), lambda a, b: a * 16 + b)"
_KEYED = "keyed AS (SELECT l_orderkey AS pos, concat('user:', CAST(l_partkey % 3000 AS VARCHAR)) AS k FROM lineitem)"
_CRLF = "chr(13) || chr(10)"


def _bulk(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN '$-1' || {_CRLF} ELSE '$' || CAST({_BYTES.format(x)} AS VARCHAR) || {_CRLF} || {x} || {_CRLF} END)"


def _error(x: str) -> str:
    return f"'-' || {x} || {_CRLF}"


def _command(*args: str) -> str:
    return f"'*{len(args)}' || {_CRLF} || " + " || ".join(map(_bulk, args))


_SET = _command("'SET'", "concat('doc:', CAST(doc_id AS VARCHAR))", "coalesce(text, '')")
_REPLY = {k: _error(_text(v)) for k, v in REPLIES.items()}
_COMMANDS = ", ".join(f"({i}, {len(c)}, {', '.join(_text(c[j]) if j < len(c) else 'NULL' for j in range(3))})" for i, c in enumerate(COMMANDS))
_BLANKS = r"[ \t\n\x0B\f\r]"
_QUOTED_LINES = ", ".join(f"({i}, {_text(x)})" for i, x in enumerate(QUOTED))
_LINES = ", ".join(f"({i}, {_text(x)})" for i, x in enumerate(LINES))
_TS = "epoch_us(ts)"

ORACLE_SQL: dict[str, str] = {
    "kv_latest": _log(_live()),
    "kv_latest_window": _log(_live()),
    "kv_latest_empty_tombstone": _log(_live("e"), "e AS (SELECT k, CASE WHEN seq % 7 = 0 THEN '' ELSE v END AS v, seq, del OR seq % 7 = 0 OR v = '' AS del FROM m)"),
    "kv_get": _log(f"SELECT p.k, l.v FROM (SELECT 'user:1' AS k) p LEFT JOIN ({_live()}) l USING (k)"),
    "kv_get_missing": _log(f"SELECT p.k, l.v FROM (SELECT 'user:none' AS k) p LEFT JOIN ({_live()}) l USING (k)"),
    "kv_multi_get": _log(f"SELECT r.pos, r.k, l.v FROM requests r LEFT JOIN ({_live()}) l USING (k)", _REQUESTS),
    "kv_semi_present": _log(f"SELECT pos, k FROM requests WHERE k IN (SELECT k FROM ({_live()}))", _REQUESTS),
    "kv_anti_deleted": _log(f"SELECT pos, k FROM requests WHERE k NOT IN (SELECT k FROM ({_live()}))", _REQUESTS),
    "kv_multi_set": _log(_live("b"), "b AS (SELECT k, v, seq, del FROM m UNION ALL SELECT concat('user:', CAST(c_custkey % 300 AS VARCHAR)), c_name, 1000000000 + c_custkey, false FROM customer)"),
    "kv_deleted_keys": _log("SELECT k, seq FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1) WHERE del"),
    "kv_memory_usage": _log(f"SELECT CAST(coalesce(sum({_BYTES.format('k')} + {_BYTES.format('v')} + 16), 0) AS BIGINT) AS bytes FROM m"),
    "kv_op_counts": _log("SELECT run, count(*) FILTER (NOT del) AS n_set, count(*) FILTER (del) AS n_del FROM m GROUP BY run"),
    "kv_memtable_collapse": _log("SELECT * FROM d", _COLLAPSE),
    "kv_flush_boundaries": _log(f"SELECT seq, k, CAST(floor(sum({_BYTES.format('k')} + {_BYTES.format('v')}) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) / {FLUSH_BYTES}) AS BIGINT) AS flush FROM m"),
    "kv_flush_runs": _log("SELECT * FROM d", _COLLAPSE),
    "kv_flush_shards": _log(f"SELECT {_poly('k', 16)} AS shard, k, v, seq, del FROM m QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1"),
    "kv_run_stats": _log(f"SELECT run, count(*) AS n, min(k) AS min_key, max(k) AS max_key, count(*) FILTER (del) AS n_tombstones, CAST(sum({_BYTES.format('k')} + {_BYTES.format('v')}) AS BIGINT) AS bytes FROM d GROUP BY run", _COLLAPSE),
    "kv_tree_stats": _log(f"SELECT CASE WHEN run >= {NEWEST_LEVEL0} THEN 0 ELSE 1 END AS level, count(DISTINCT run) AS n_tables, count(*) AS n_keys, min(k) AS min_key, max(k) AS max_key FROM d GROUP BY 1", _COLLAPSE),
    "kv_wal_replay": _log("SELECT k, v, seq, del FROM m QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1"),
    "kv_wal_tail": _log("SELECT k, v, seq, del FROM m WHERE run = (SELECT max(run) FROM m)"),
    "kv_seed": _log(f"{_live()} UNION ALL SELECT 'system:version', '1.0', 0"),
    "kv_layered_read": _log("SELECT k, v, CASE WHEN run = (SELECT max(run) FROM m) THEN 'memtable' WHEN run >= (SELECT max(run) FROM m) - 4 THEN 'L0' ELSE 'L1' END AS layer FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1) WHERE NOT del"),
    "kv_version_history": _log("SELECT k, seq, lag(seq) OVER w AS prev_seq, lead(seq) OVER w AS next_seq FROM m WINDOW w AS (PARTITION BY k ORDER BY seq)"),
    "kv_sorted_scan": _log(f"SELECT k, v FROM ({_live()}) ORDER BY k LIMIT 100"),
    "kv_range_prune": f"""WITH {_ORDERS.format(shift=0)}, r AS (SELECT run, min(k) AS a, max(k) AS b FROM o GROUP BY run), p AS (SELECT concat('order:', lpad(CAST(c_custkey * 7 AS VARCHAR), 8, '0')) AS k FROM customer)
        SELECT k, count(a) AS n_runs FROM p LEFT JOIN r ON k BETWEEN a AND b GROUP BY k""",
    "kv_compaction_overlap": f"""WITH {_ORDERS.format(shift=500)}, u AS (SELECT run, min(k) AS a, max(k) AS b FROM o GROUP BY run), l AS (SELECT CAST(floor(o_orderkey / 1000) AS BIGINT) AS run,
        min(concat('order:', lpad(CAST(o_orderkey AS VARCHAR), 8, '0'))) AS a, max(concat('order:', lpad(CAST(o_orderkey AS VARCHAR), 8, '0'))) AS b FROM orders GROUP BY 1)
        SELECT u.run AS upper_run, l.run AS lower_run FROM u JOIN l ON greatest(u.a, l.a) <= least(u.b, l.b)""",
    "kv_level_remaining": f"""WITH {_ORDERS.format(shift=500)}, u AS (SELECT run, min(k) AS a, max(k) AS b FROM o WHERE run < 4 GROUP BY run), l AS (SELECT CAST(floor(o_orderkey / 1000) AS BIGINT) AS run,
        min(concat('order:', lpad(CAST(o_orderkey AS VARCHAR), 8, '0'))) AS a, max(concat('order:', lpad(CAST(o_orderkey AS VARCHAR), 8, '0'))) AS b FROM orders GROUP BY 1)
        SELECT run FROM l EXCEPT SELECT l.run FROM u JOIN l ON greatest(u.a, l.a) <= least(u.b, l.b)""",
    "kv_keys_in_all_runs": _early(" INTERSECT ".join(f"SELECT k FROM m WHERE run = {i}" for i in range(5))),
    "kv_fence_pointers": _log("SELECT run, k, position FROM (SELECT run, k, row_number() OVER (PARTITION BY run ORDER BY k) - 1 AS position FROM d) WHERE position % 16 = 0", _COLLAPSE),
    "kv_fence_lookup": _log("""SELECT q.run, q.k, coalesce(max(f.position), 0) AS fence FROM (SELECT run, k FROM (SELECT DISTINCT run FROM m), (SELECT DISTINCT k FROM requests)) q
        LEFT JOIN f ON f.run = q.run AND f.k <= q.k GROUP BY q.run, q.k""", _REQUESTS, _COLLAPSE, "f AS (SELECT * FROM (SELECT run, k, row_number() OVER (PARTITION BY run ORDER BY k) - 1 AS position FROM d) WHERE position % 16 = 0)"),
    "kv_compact_a": _early(_live()),
    "kv_compact_l0_b": _early("SELECT k, v, seq, del FROM (SELECT k, arg_max(v, seq) AS v, max(seq) AS seq, arg_max(del, seq) AS del, count(DISTINCT run) AS held FROM m GROUP BY k) WHERE NOT del OR held < (SELECT count(DISTINCT run) FROM m)"),
    "kv_compact_deep_b": _log(_live("old"), "old AS (SELECT * FROM m WHERE run IN (SELECT DISTINCT run FROM m ORDER BY run LIMIT 5))"),
    "kv_compact_safe": _log(_live()),
    "kv_compact_resurrected": _log(f"""SELECT k FROM ({_live('low', 'k')}) WHERE k IN (SELECT k FROM (SELECT * FROM m WHERE run < 10 QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1) WHERE del)
        AND k NOT IN ({_live('high', 'k')})""", "low AS (SELECT * FROM m WHERE run < 5)", "high AS (SELECT * FROM m WHERE run BETWEEN 5 AND 9)"),
    "kv_compaction_due": _log(f"SELECT level, n_tables, n_tables > CASE WHEN level = 0 THEN 4 ELSE 10 END AS due FROM (SELECT CASE WHEN run >= {NEWEST_LEVEL0} THEN 0 ELSE 1 END AS level, count(DISTINCT run) AS n_tables FROM m GROUP BY 1)"),
    "kv_shard_stats": _log(f"SELECT {_poly('k', 16)} AS shard, count(*) AS n_keys, CAST(sum({_BYTES.format('k')} + {_BYTES.format('v')} + 16) AS BIGINT) AS bytes FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1) GROUP BY 1"),
    "kv_bloom_params": _log("SELECT run, n, n * 10 AS a_bits, CAST(7 AS BIGINT) AS a_hashes, b_bits, b_hashes FROM sizes", _COLLAPSE, _sizes()),
    "kv_bloom_bits": _log(_positions("run"), _REQUESTS, _COLLAPSE, _sizes(), _HASHED),
    "kv_bloom_segmented": _log(_positions(f"run, {_poly('k', 4)} AS segment"), _REQUESTS, _COLLAPSE, _sizes(4), _HASHED),
    "kv_bloom_probe": _log(f"SELECT run, k, bool_and(b.position IS NOT NULL) AS might_contain FROM ({_positions('run, k', 'asked')}) p LEFT JOIN bits b USING (run, position) GROUP BY run, k",
        _REQUESTS, _COLLAPSE, _sizes(), _HASHED, f"bits AS ({_positions('run')})", "asked AS (SELECT run, k FROM (SELECT DISTINCT run FROM m), (SELECT DISTINCT k FROM requests))"),
    "kv_common_prefix": f"""WITH {_ORDERS.format(shift=0)}, p AS (SELECT run, list_max(list_filter(range(0, 15), lambda i: left(a, CAST(i AS BIGINT)) = left(b, CAST(i AS BIGINT)))) AS n, a FROM (SELECT run, min(k) AS a, max(k) AS b FROM o GROUP BY run))
        SELECT run, k, left(a, n) AS prefix, substr(k, n + 1) AS suffix FROM (SELECT DISTINCT run, k FROM o) JOIN p USING (run)""",
    "kv_lru_state": _log(f"""SELECT k, last_seq, CAST(row_number() OVER (ORDER BY last_seq DESC) AS INTEGER) AS place FROM (
        SELECT t.k, t.last_seq FROM top t LEFT JOIN depth d ON d.k = t.k GROUP BY t.k, t.last_seq HAVING coalesce(max(d.n), 0) < {LRU_KEYS})""",
        f"top AS (SELECT k, seq AS last_seq FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1) WHERE NOT del ORDER BY seq DESC LIMIT {LRU_KEYS})",
        "moves AS (SELECT t.k AS of, m.k, m.seq, m.del, lag(m.del) OVER (PARTITION BY t.k, m.k ORDER BY m.seq) AS gone FROM top t JOIN m ON m.seq > t.last_seq)",
        "depth AS (SELECT of AS k, sum(CASE WHEN NOT del AND coalesce(gone, true) THEN 1 WHEN del AND NOT coalesce(gone, true) THEN -1 ELSE 0 END) OVER (PARTITION BY of ORDER BY seq) AS n FROM moves)"),
    "kv_lru_segmented": _log(f"""SELECT segment, k, last_seq, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY last_seq DESC) AS place FROM (
        SELECT {_SEGMENT} AS segment, k, last_seq FROM (SELECT k, max(seq) AS last_seq FROM m GROUP BY k))) WHERE place <= {LRU_SEGMENT_KEYS}"""),
    "kv_cache_segment": _log(f"SELECT k, {_SEGMENT} AS segment FROM (SELECT DISTINCT k FROM m)"),
    "kv_bloom_a": _log("SELECT DISTINCT run, CAST(md5_number_bits(i, k) % a_bits AS BIGINT) AS position FROM d JOIN (SELECT run, count(*) * 10 AS a_bits FROM d GROUP BY run) USING (run), range(7) t(i)".replace("md5_number_bits(i, k)", _MD5), _COLLAPSE),
    "client_tokenize": f"SELECT pos, array_to_string(list_filter(list_transform(regexp_extract_all(line, '(?:[^ \"]|\"[^\"]*(?:\"|$))+'), lambda x: replace(x, '\"', '')), lambda x: x <> ''), '|') AS tokens FROM (VALUES {_QUOTED_LINES}) t(pos, line)",
    "batch_get": _log(f"SELECT r.pos, r.k, l.v FROM keyed r LEFT JOIN ({_live()}) l USING (k)", _KEYED),
    "batch_set": _log(_live("b"), _KEYED, "b AS (SELECT k, v, seq, del FROM m UNION ALL SELECT k, CAST(pos AS VARCHAR), pos + 1000000000, false FROM keyed)"),
    "kv_operation_log": _log("SELECT seq, CASE WHEN del THEN concat('[LOG] DEL ', k) ELSE concat('[LOG] SET ', k, ' ', v) END AS line FROM m"),
    "kv_empty_shards": _log(f"SELECT CAST(s AS INTEGER) AS shard, s NOT IN (SELECT {_poly('k', 16)} FROM m WHERE run = (SELECT max(run) FROM m)) AS empty FROM range(16) t(s)"),
    "kv_compact_expired": _log("""SELECT k, v, seq, del FROM (SELECT m.*, ts FROM m JOIN events ON event_id = seq QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1)
        WHERE NOT (del AND ts <= (SELECT max(ts) FROM events) - INTERVAL 24 HOURS)"""),
    "kv_token_bucket": f"""WITH RECURSIVE r AS (SELECT user_id AS who, event_id AS seq, {_TS} AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        s(who, n, seq, last, tokens, admitted) AS (
          SELECT who, n, seq, t, CAST({BUCKET_CAPACITY} - 1 AS BIGINT), true FROM r WHERE n = 1
          UNION ALL
          SELECT who, n, seq, last, tokens - CASE WHEN tokens > 0 THEN 1 ELSE 0 END, tokens > 0 FROM (
            SELECT r.who, r.n, r.seq, CASE WHEN (r.t - s.last) // 1000000 > 0 THEN r.t ELSE s.last END AS last,
              CASE WHEN (r.t - s.last) // 1000000 > 0 THEN least({BUCKET_CAPACITY}, s.tokens + ((r.t - s.last) // 1000000) * {BUCKET_RATE}) ELSE s.tokens END AS tokens
            FROM s JOIN r ON r.who = s.who AND r.n = s.n + 1))
        SELECT who, seq, admitted FROM s""",
    "kv_adaptive_freq": """SELECT run, n_reads, n_writes, ratio, CASE WHEN ratio > 10 THEN 9 WHEN ratio < 1 THEN 11 ELSE 10 END AS tenths FROM (
        SELECT *, CAST(floor(n_reads / greatest(n_writes, 1)) AS BIGINT) AS ratio FROM (SELECT CAST(floor(event_id / 20) AS BIGINT) AS run, count(*) FILTER (event_type IN ('view', 'click')) AS n_reads, count(*) FILTER (event_type NOT IN ('view', 'click')) AS n_writes FROM events GROUP BY 1))""",
    "kv_adaptive_freq_running": """WITH RECURSIVE w AS (SELECT run, CAST(floor(n_reads / greatest(n_writes, 1)) AS BIGINT) AS ratio, row_number() OVER (ORDER BY run) AS n FROM (
          SELECT CAST(floor(event_id / 20) AS BIGINT) AS run, count(*) FILTER (event_type IN ('view', 'click')) AS n_reads, count(*) FILTER (event_type NOT IN ('view', 'click')) AS n_writes FROM events GROUP BY 1)),
        s(n, run, ratio, tenths) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 10 UNION ALL
          SELECT w.n, w.run, w.ratio, CASE WHEN w.ratio > 10 THEN greatest(5, s.tenths - 1) WHEN w.ratio < 1 THEN least(20, s.tenths + 1) ELSE s.tenths END FROM s JOIN w ON w.n = s.n + 1)
        SELECT run, ratio, tenths FROM s WHERE n > 0""",
    "resp_encode": f"SELECT doc_id, {_SET} AS wire FROM documents",
    "resp_decode": "SELECT doc_id, 'SET' AS command, concat('doc:', CAST(doc_id AS VARCHAR)) AS k, coalesce(text, '') AS v FROM documents",
    "resp_dispatch": _log(f"""SELECT pos, CASE WHEN n = 0 THEN {_REPLY['format']} WHEN a IS NULL THEN {_REPLY['string']}
        WHEN upper(a) = 'SET' THEN CASE WHEN n < 3 THEN {_REPLY['set_arity']} WHEN k IS NULL OR x IS NULL THEN {_REPLY['set_type']} ELSE '+OK' || {_CRLF} END
        WHEN upper(a) = 'GET' THEN CASE WHEN n < 2 THEN {_REPLY['get_arity']} WHEN k IS NULL THEN {_REPLY['get_type']} ELSE {_bulk('v')} END
        WHEN upper(a) = 'DEL' THEN CASE WHEN n < 2 THEN {_REPLY['del_arity']} WHEN k IS NULL THEN {_REPLY['del_type']} ELSE ':1' || {_CRLF} END
        ELSE {_error("'Unknown command: ' || upper(a)")} END AS reply
        FROM (VALUES {_COMMANDS}) c(pos, n, a, k, x) LEFT JOIN ({_live(columns='k, v')}) l USING (k)"""),
    "resp_pipeline": " UNION ALL ".join(f"SELECT c_custkey AS conn, {i} AS pos, '{c}' AS command, concat('user:', CAST(c_custkey AS VARCHAR)) AS k, {v} AS v, 'ok' AS status FROM customer" for i, (c, v) in enumerate([("SET", "c_name"), ("get", "CAST(NULL AS VARCHAR)"), ("DEL", "CAST(NULL AS VARCHAR)")])),
    "repl_parse": f"""WITH l(pos, line) AS (VALUES {_LINES}), w AS (SELECT pos, line, list_filter(regexp_split_to_array(line, '{_BLANKS}+'), lambda x: x <> '') AS t FROM l),
        p AS (SELECT pos, line, upper(t[1]) AS c, t[2] AS k, len(t) AS n FROM w),
        e AS (SELECT *, CASE WHEN c = 'SET' AND n < 3 THEN 'Error: SET requires a key and a value' WHEN c = 'GET' AND n < 2 THEN 'Error: GET requires a key' WHEN c = 'DEL' AND n < 2 THEN 'Error: DEL requires a key'
          WHEN n > 0 AND c NOT IN ('SET', 'GET', 'DEL', 'SYNC', 'DEBUG', 'EXIT', 'QUIT') THEN 'Unknown command.' END AS error FROM p)
        SELECT pos, c AS command, CASE WHEN c IN ('SET', 'GET', 'DEL') AND error IS NULL THEN k END AS key,
          CASE WHEN c = 'SET' AND error IS NULL THEN regexp_replace(substr(line, instr(line, k) + length(k)), '^{_BLANKS}+', '') END AS value, error FROM e""",
    "client_format": _log(f"""SELECT concat('get ', k) AS of, '"' || v || '"' AS shown FROM ({_live()}) UNION ALL
        SELECT * FROM (VALUES ('ok', 'OK'), ('error', 'ERROR: bad'), ('one', '(1)'), ('none', 'NULL'), ('no array', 'NULL ARRAY'), ('array', concat('Array[2]:', chr(10), '  0) (7)', chr(10), '  1) "a"', chr(10))))"""),
    "stream_kv_latest": _log(_live()),
    "kv_range_scan": _log(f"SELECT k, v FROM ({_live()}) WHERE k BETWEEN 'user:2' AND 'user:4'"),
}

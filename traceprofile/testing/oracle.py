"""DuckDB texts that answer the registered queries independently."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# The same bindings as bindings.py, in DuckDB's dialect. Method names,
# prefixes and keywords, as in the predicates they check.
# ---------------------------------------------------------------------------
_SLICE = """
ev AS (
  SELECT event_id, user_id, ts, value, event_type et,
         CAST(props->>'$.k' AS INTEGER) k, event_id // 40 AS block,
         CASE WHEN (event_id // 40) % 3 = 0 THEN 'hot'
              ELSE 't' || CAST((event_id // 10000) * 4 + (event_id // 40) % 4 AS VARCHAR) END trace_id
  FROM events),
slice AS (
  SELECT trace_id, event_id id, user_id + 100000 track_id,
    CASE WHEN event_id % 40 <> 0 THEN event_id - 1 END parent_id,
    CASE et
      WHEN 'click' THEN 'void com.app.ui.Screen' || CAST(k % 7 AS VARCHAR) || '.onClick(View)'
      WHEN 'view' THEN CASE k % 3 WHEN 0 THEN 'Choreographer#doFrame'
          WHEN 1 THEN 'void com.app.View' || CAST(k % 5 AS VARCHAR) || '.performTraversal()'
          ELSE 'boolean android.view.View.draw(Canvas)' END
      WHEN 'purchase' THEN CASE k % 4
          WHEN 0 THEN 'void com.app.db.SQLiteOrders.insert(Order)'
          WHEN 1 THEN 'Binder transact' WHEN 2 THEN 'HTTP fetch'
          ELSE 'void com.app.pay.Checkout.submit()' END
      WHEN 'signup' THEN CASE k % 7
          WHEN 0 THEN 'java.lang.Object kotlin.coroutines.Resume.run()'
          WHEN 1 THEN 'com.app.Login$submit$1$2.invokeSuspend()'
          WHEN 2 THEN 'com.app.Login$submit$1.invokeSuspend()'
          WHEN 3 THEN 'com.app.Login$session$2.invoke()'
          WHEN 4 THEN 'com.app.Login$1.run()'
          WHEN 5 THEN 'msdocker.hook.Proxy.call()'
          ELSE 'com.app.Ill111l.get()' END
      ELSE CASE k % 3 WHEN 0 THEN 'void com.app.log.FilePrinter.print(String)'
          WHEN 1 THEN 'com.app.Foo.a3()' ELSE 'void com.app.data.Profile.load()' END
    END AS name,
    (epoch_us(ts) // 3600000000) * 3600000000000 ts,
    CAST(floor(value / 10) AS BIGINT) * 20000000 + k % 3 * 150000 dur
  FROM ev),
thread AS (
  SELECT DISTINCT trace_id, user_id utid, user_id + 1000 tid,
    CASE WHEN user_id % 5 = 0 THEN 'main' ELSE 'worker-' || CAST(user_id AS VARCHAR) END AS name,
    CASE WHEN user_id % 7 = 0 THEN 1 WHEN user_id % 7 = 3 THEN NULL ELSE 0 END is_main_thread
  FROM ev),
thread_track AS (SELECT trace_id, utid + 100000 id, utid FROM thread),
process AS (SELECT trace_id, tid pid FROM thread WHERE utid % 11 = 1),
first_pid AS (SELECT trace_id, min(pid) pid FROM process GROUP BY trace_id),
joined AS (
  SELECT s.*, t.name thread_name, t.tid, t.is_main_thread, p.pid
  FROM slice s
  JOIN thread_track tt ON s.trace_id = tt.trace_id AND s.track_id = tt.id
  JOIN thread t ON tt.trace_id = t.trace_id AND tt.utid = t.utid
  LEFT JOIN first_pid p ON p.trace_id = s.trace_id)"""

_MAIN = "(is_main_thread = 1 OR tid = pid OR thread_name = 'main')"
_MAIN_NAME_PID = "(thread_name = 'main' OR tid = pid)"
_MAIN_NAME_FLAG = "(thread_name = 'main' OR is_main_thread = 1)"
_APP_CODE = " AND ".join(
    f"name NOT ILIKE '{p}%'"
    for p in (
        "void com.android.internal.", "void android.", "boolean android.", "int android.",
        "java.lang.Object android.", "void java.", "java.lang.", "void kotlin.", "kotlin.",
        "java.lang.Object kotlin.", "kotlinx.coroutines.Job kotlin.",
        "void kotlinx.coroutines.", "java.lang.Object kotlinx.coroutines.",
        "kotlinx.coroutines.",
    )
)
_FRAME = "(name ILIKE '%doFrame%' OR name ILIKE '%Choreographer%' OR name ILIKE '%traversal%')"
_IO = ("(name ILIKE '%Binder%' OR name ILIKE '%sqlite%' OR name ILIKE '%SharedPreferences%' "
       "OR name ILIKE '%File%' OR name ILIKE '%network%' OR name ILIKE '%http%')")


def _hits(cte: str, kind: str, where: str, limit: int, dedupe: bool) -> str:
    fold = ("QUALIFY row_number() OVER (PARTITION BY trace_id, ts, dur ORDER BY id) = 1"
            if dedupe else "")
    order = "dur DESC, ts" if dedupe else "dur DESC, id"
    return f"""
{cte}_rows AS (SELECT trace_id, id, name, ts, dur, parent_id FROM joined WHERE {where} {fold}),
{cte} AS (
  SELECT trace_id, '{kind}' kind,
         CAST(row_number() OVER (PARTITION BY trace_id ORDER BY {order}) AS INTEGER) pos,
         id, name, dur / 1e6 dur_ms, ts, dur, parent_id
  FROM {cte}_rows
  QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY {order}) <= {limit})"""


def _cpu(cte: str, source: str, where: str) -> str:
    return f"""
{cte}_stats AS (
  SELECT trace_id, name, count(*) "count", CAST(sum(dur) AS BIGINT) total_ns
  FROM {source} WHERE {where} GROUP BY trace_id, name HAVING count(*) > 5),
{cte} AS (
  SELECT trace_id, 'cpu' kind,
         CAST(row_number() OVER (PARTITION BY trace_id ORDER BY total_ns DESC, name) AS INTEGER) pos,
         name, "count", total_ns / 1e6 total_ms,
         CAST(total_ns AS DOUBLE) / "count" / 1e6 avg_ms
  FROM {cte}_stats
  QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY total_ns DESC, name) <= 30)"""


_LONG = _hits("long_slices", "long", f"{_MAIN} AND {_APP_CODE}", 30, True)
_JANK = _hits("frame_jank", "jank", f"{_MAIN} AND {_FRAME} AND dur > 16600000", 20, True)
_IOHITS = _hits("main_thread_io", "io", f"{_MAIN} AND {_IO}", 20, True)
_CPU = _cpu("cpu_heavy", "joined", f"{_MAIN} AND {_APP_CODE}")
_FOUR = f"{_SLICE}, {_LONG}, {_JANK}, {_IOHITS}, {_CPU}"


def _with(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{select}"


def _one(cte: str, text: str) -> str:
    return _with(f"{_SLICE}, {text}", f"SELECT * FROM {cte}")


def _variant(kind: str, where: str, limit: int) -> str:
    return _one("found", _hits("found", kind, where, limit, False))



def _fixed1(x: str) -> str:
    """One decimal; printf rounds exact quarters to even, they go up here."""
    return (f"CASE WHEN ({x}) - floor({x}) IN (0.25, 0.75) THEN printf('%.1f', ({x}) + 0.01) "
            f"ELSE printf('%.1f', {x}) END")


_NAME = "'`' || name || '`'"
_MS = _fixed1("raw")
_AVG = _fixed1("avg_ms")
_RATIO = _fixed1("raw / 16.6::DOUBLE")
_SEVERITY = ("CASE WHEN {0} > 500 THEN 'P0' WHEN {0} > 200 THEN 'P1' "
             "WHEN {0} > 100 THEN 'P2' ELSE 'P3' END")

_COUNTED = """
counted AS (
  SELECT trace_id, kind, 0 ko, pos, id, name, ts, dur, dur_ms raw,
         NULL::BIGINT "count", NULL::DOUBLE avg_ms FROM long_slices WHERE dur_ms > 50
  UNION ALL
  SELECT trace_id, kind, 1, pos, id, name, ts, dur, dur_ms, NULL, NULL FROM frame_jank
  UNION ALL
  SELECT trace_id, kind, 2, pos, id, name, ts, dur, dur_ms, NULL, NULL FROM main_thread_io
  WHERE dur_ms > 50
  UNION ALL
  SELECT trace_id, kind, 3, pos, NULL, name, NULL, NULL, total_ms, "count", avg_ms
  FROM cpu_heavy)"""

# The texts of issues.
_TEXT_COLUMNS = f"""
  {_SEVERITY.format('raw')} severity,
  CASE kind WHEN 'long' THEN '主线程长耗时: ' WHEN 'jank' THEN '帧卡顿: '
            WHEN 'io' THEN '主线程 I/O: ' ELSE 'CPU 密集型方法: ' END || name title,
  CASE kind
    WHEN 'long' THEN '主线程方法 ' || {_NAME} || ' 单次执行耗时 ' || {_MS} || 'ms，可能导致 UI 卡顿'
    WHEN 'jank' THEN '帧渲染方法 ' || {_NAME} || ' 耗时 ' || {_MS} || 'ms，超过 16.6ms 帧预算'
    WHEN 'io' THEN '主线程上执行了 I/O 操作 ' || {_NAME} || '，耗时 ' || {_MS} || 'ms'
    ELSE '方法 ' || {_NAME} || ' 被调用 ' || "count" || ' 次，总耗时 ' || {_MS} || 'ms（平均 '
         || {_AVG} || 'ms/次）' END what,
  {_NAME} "where",
  CASE kind WHEN 'cpu' THEN {_MS} || 'ms (' || "count" || '次, 平均' || {_AVG} || 'ms)'
            ELSE {_MS} || 'ms' END duration,
  CASE kind
    WHEN 'long' THEN CASE WHEN raw > 500 THEN '严重阻塞主线程，用户可感知明显卡顿或无响应'
        WHEN raw > 200 THEN '主线程阻塞时间较长，可能导致掉帧和交互延迟'
        WHEN raw > 100 THEN '主线程有一定阻塞，可能在低端设备上引起卡顿'
        ELSE '轻微影响，建议关注' END
    WHEN 'jank' THEN '帧渲染超时 ' || {_RATIO} || ' 倍，用户可感知明显掉帧'
    WHEN 'io' THEN '主线程 I/O 操作会阻塞 UI 渲染，导致卡顿和 ANR 风险'
    ELSE CASE WHEN raw > 500 THEN '累计耗时极高，严重消耗 CPU 资源，影响整体性能'
        WHEN raw > 200 THEN '累计耗时较高，占用较多 CPU 资源'
        ELSE '有一定 CPU 开销，建议关注' END END impact,
  CASE kind
    WHEN 'long' THEN '考虑将 ' || {_NAME} || ' 的耗时操作移至后台线程，或优化其执行逻辑以减少耗时'
    WHEN 'jank' THEN '优化帧渲染流程，减少 ' || {_NAME} || ' 中的同步操作，避免在 doFrame 中执行耗时任务'
    WHEN 'io' THEN '将 ' || {_NAME} || ' 移至后台线程执行，使用异步 API 或 WorkManager 处理 I/O 操作'
    ELSE '优化 ' || {_NAME} || ' 的实现，减少调用频次或单次执行耗时，考虑缓存计算结果' END suggestion"""

_RATED = f"""{_COUNTED},
worst AS (
  SELECT *, min(pos) OVER (PARTITION BY trace_id, kind, name) first_pos,
         row_number() OVER (PARTITION BY trace_id, kind, name
                            ORDER BY {_SEVERITY.format('raw')}, raw DESC, pos) rn
  FROM counted),
rated AS (
  SELECT trace_id, kind, id, ts, dur, raw duration_raw, name,
    CAST(row_number() OVER (PARTITION BY trace_id
         ORDER BY {_SEVERITY.format('raw')}, raw DESC, ko, first_pos) AS INTEGER) "position",
    {_TEXT_COLUMNS}
  FROM worst WHERE rn = 1)"""


def _note(name: str) -> str:
    """Note on a compiler-made name. Patterns and texts of the notes."""
    return rf"""CASE
  WHEN regexp_matches({name}, '\w+\$\w+\$\d+\$\d+\.invokeSuspend\b') THEN '← Kotlin lambda in '
    || regexp_extract({name}, '(\w+)\$(\w+)\$\d+\$\d+\.invokeSuspend', 1) || '.'
    || regexp_extract({name}, '(\w+)\$(\w+)\$\d+\$\d+\.invokeSuspend', 2) || '()'
  WHEN regexp_matches({name}, '\w+\$\w+\$\d+\.invokeSuspend\b') THEN '← coroutine continuation of '
    || regexp_extract({name}, '(\w+)\$(\w+)\$\d+\.invokeSuspend', 1) || '.'
    || regexp_extract({name}, '(\w+)\$(\w+)\$\d+\.invokeSuspend', 2) || '()'
  WHEN regexp_matches({name}, '\w+\$\w+\$\d+\.invoke\b') THEN '← lazy init of '
    || regexp_extract({name}, '(\w+)\$(\w+)\$\d+\.invoke', 1) || '.'
    || regexp_extract({name}, '(\w+)\$(\w+)\$\d+\.invoke', 2)
  WHEN regexp_matches({name}, '\w+\$\d+\.run\b') THEN '← anonymous Runnable in '
    || regexp_extract({name}, '(\w+)\$\d+\.run', 1)
  WHEN regexp_matches({name}, '\.[A-Za-z]\d(\(|$)') THEN '← obfuscated method (ProGuard)'
  WHEN regexp_matches({name}, '\bmsdocker\.|\b[Il1i]{{4,}}\b')
    THEN '← DroidPlugin hook / string decryption'
  ELSE '' END"""


def _stack(seeds: str, noted: bool = False) -> str:
    """Stack text per seed from a CTE with ``(trace_id, slice_id)``."""
    note = f"CASE WHEN {_note('name')} <> '' THEN ' ' || {_note('name')} ELSE '' END" if noted else "''"
    return f"""
walk AS (
  SELECT d.trace_id, d.slice_id, 0 lvl, s.id, s.name, s.parent_id
  FROM {seeds} d JOIN slice s ON s.trace_id = d.trace_id AND s.id = d.slice_id
  UNION ALL
  SELECT w.trace_id, w.slice_id, w.lvl + 1, s.id, s.name, s.parent_id
  FROM walk w JOIN slice s ON s.trace_id = w.trace_id AND s.id = w.parent_id
  WHERE w.lvl < 25),
walk_size AS (
  SELECT trace_id, slice_id, count(*) n,
         count(*) > 25 AND arg_max(parent_id IS NOT NULL, lvl) truncated
  FROM walk GROUP BY ALL),
stack_text AS (
  SELECT trace_id, slice_id, n, truncated,
    string_agg(CASE WHEN lvl < n - 1 THEN repeat('  ', CAST(n - 1 - lvl AS BIGINT)) || '→ ' ELSE '' END
               || name || '()' || {note} || CASE WHEN lvl = 0 THEN '          ← 瓶颈' ELSE '' END,
               chr(10) ORDER BY lvl DESC)
    || CASE WHEN truncated THEN chr(10) || repeat('  ', CAST(n AS BIGINT)) || '... (调用栈已截断)'
            ELSE '' END call_stack
  FROM walk JOIN walk_size USING (trace_id, slice_id)
  GROUP BY trace_id, slice_id, n, truncated)"""


_STACK_SELECT = "SELECT trace_id, slice_id, CAST(n AS INTEGER) entries, truncated, call_stack FROM stack_text"

_ISSUES = f"""{_FOUR}, {_RATED},
seeds AS (SELECT DISTINCT trace_id, id slice_id FROM rated WHERE id IS NOT NULL), {_stack('seeds')},
issues AS (
  SELECT r.* EXCLUDE (name), coalesce(t.call_stack, '') call_stack
  FROM rated r LEFT JOIN stack_text t ON t.trace_id = r.trace_id AND t.slice_id = r.id)"""

_COUNTS = """
counts AS (
  SELECT trace_id, count(*) FILTER (severity = 'P0') p0, count(*) FILTER (severity = 'P1') p1,
         count(*) FILTER (severity = 'P2') p2, count(*) FILTER (severity = 'P3') p3,
         count(*) total
  FROM rated GROUP BY trace_id)"""

# The texts of the summary and the report.
_SUMMARY = """
summary AS (
  SELECT t.trace_id, CASE WHEN coalesce(total, 0) = 0
    THEN '本次 trace 分析未发现显著性能问题，应用整体运行状况良好。'
    ELSE '本次分析共发现 ' || total || ' 个性能问题，其中 ' || concat_ws('、',
        CASE WHEN p0 > 0 THEN p0 || ' 个 P0（阻塞级）' END,
        CASE WHEN p1 > 0 THEN p1 || ' 个 P1（严重）' END,
        CASE WHEN p2 > 0 THEN p2 || ' 个 P2（中等）' END,
        CASE WHEN p3 > 0 THEN p3 || ' 个 P3（轻微）' END) || '。' ||
      CASE WHEN p0 > 0 THEN '存在阻塞级问题，建议优先处理 P0 问题以改善用户体验。'
           WHEN p1 > 0 THEN '建议优先关注 P1 级别问题。' ELSE '' END
    END summary
  FROM (SELECT DISTINCT trace_id FROM thread) t LEFT JOIN counts USING (trace_id))"""

_REPORT = f"""{_ISSUES}, {_COUNTS}, {_SUMMARY},
blocks AS (
  SELECT trace_id, string_agg(
      '### [' || severity || '] ' || title || chr(10) || '- **What**: ' || what || chr(10)
      || '- **Where**: ' || "where" || chr(10) || '- **Duration**: ' || duration || chr(10)
      || '- **Impact**: ' || impact || chr(10)
      || CASE WHEN call_stack <> '' THEN '- **Call Stack**:' || chr(10) || '  ```' || chr(10) || '  '
           || replace(call_stack, chr(10), chr(10) || '  ') || chr(10) || '  ```' || chr(10) ELSE '' END
      || '- **Suggestion**: ' || suggestion || chr(10), chr(10) ORDER BY "position") body
  FROM issues GROUP BY trace_id),
report AS (
  SELECT s.trace_id, '# Perfetto Trace 性能分析报告' || chr(10) || chr(10)
    || '**分析时间**: 2024-01-15 10:30:45' || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10)
    || summary || chr(10) || chr(10) || '## Issues' || chr(10) || chr(10)
    || coalesce(body, '未发现显著性能问题。' || chr(10)) markdown
  FROM summary s LEFT JOIN blocks b ON b.trace_id = s.trace_id)"""


def _windows(pad: str) -> str:
    margin = {"tenth": "CAST(floor(CAST(dur AS DOUBLE) * 0.1::DOUBLE + 0.5::DOUBLE) AS BIGINT)",
              "third": "(dur // 3)", "none": "0"}[pad]
    start = f"CASE WHEN ts - {margin} > 0 THEN ts - {margin} ELSE ts END" if pad == "tenth" \
        else f"ts - {margin}"
    return (f"SELECT trace_id, kind, id, \"position\", '{pad}' pad, "
            f"CAST({start} AS BIGINT) window_start, CAST(dur + 2 * {margin} AS BIGINT) window_width "
            "FROM rated WHERE ts IS NOT NULL AND dur IS NOT NULL")


# ---------------------------------------------------------------------------
# Sampling tables
# ---------------------------------------------------------------------------
_SAMPLES = """
samples AS (
  SELECT CASE WHEN (o_orderkey // 500) % 3 = 0 THEN 'hot'
      ELSE 's' || CAST((o_orderkey // 50000) * 4 + (o_orderkey // 500) % 4 AS VARCHAR) END trace_id,
    o_orderkey sample_ord, o_orderkey // 500 AS block,
    CASE WHEN o_orderkey % 3 = 1 THEN [3::BIGINT, 2, 1] ELSE list_concat(
      CASE WHEN o_orderkey % 1000 = 17 THEN [-o_orderkey - 1] ELSE CAST([] AS BIGINT[]) END,
      list_transform(range(0, o_orderkey % 12 + 1), lambda i: o_custkey + i * (o_orderkey % 5)),
      [1::BIGINT]) END frames
  FROM orders),
mapping AS (
  SELECT p_partkey addr, CASE
    WHEN p_partkey = 1 THEN 'void android.app.ActivityThread.main(java.lang.String[])'
    WHEN p_partkey = 2 THEN 'void android.os.Looper.loop()'
    WHEN p_partkey = 3 THEN 'android.os.Message android.os.MessageQueue.next()'
    WHEN p_partkey % 97 = 0 THEN
      '<runtime method>.<runtime internal callee-save reference registers method>'
    WHEN p_partkey % 20 = 11 THEN CASE (p_partkey // 20) % 6
      WHEN 0 THEN 'org.json.JSONObject org.json.JSONObject.put(java.lang.String)'
      WHEN 1 THEN 'java.lang.Object java.lang.reflect.Method.invoke(java.lang.Object)'
      WHEN 2 THEN 'void com.vivo.perf.Monitor.tick()'
      WHEN 3 THEN 'void androidx.room.RoomDatabase.query(java.lang.String)'
      WHEN 4 THEN 'void android.view.Choreographer.doFrame(long)'
      ELSE 'void com.app.log.FilePrinter.print(java.lang.String)' END
    WHEN p_partkey % 3 = 0 THEN
      'void com.shop.' || replace(p_name, ' ', '.') || '.m' || CAST(p_partkey AS VARCHAR) || '()'
    ELSE 'void com.shop.' || replace(p_name, ' ', '.') || '(' || p_brand || ')' END AS name
  FROM part)"""

_NAMED = """
flat AS (SELECT trace_id, sample_ord, unnest(frames) addr,
                generate_subscripts(frames, 1) - 1 frame_pos FROM samples),
frames_named AS (
  SELECT f.trace_id, f.sample_ord, CAST(f.frame_pos AS INTEGER) frame_pos, f.addr,
         coalesce(m.name, 'native:0x' || lower(to_hex(f.addr))) AS name
  FROM flat f LEFT JOIN mapping m USING (addr)),
totals AS (SELECT trace_id, count(*) sample_count FROM samples GROUP BY trace_id)"""
_FRAMES = f"{_SAMPLES}, {_NAMED}"

# samples that survive the encoded files, each file a trace of its own
_FILE_FRAMES = f"""{_SAMPLES},
file_samples AS (SELECT trace_id || '-' || block trace_id, sample_ord, frames FROM samples
                 WHERE block % 7 <> 3 AND block % 9 <> 4), {_NAMED}""".replace(
    "1) - 1 frame_pos FROM samples", "1) - 1 frame_pos FROM file_samples"
).replace("sample_count FROM samples", "sample_count FROM file_samples")


def _methods(where: str, extra: str = "", frames: str = _FRAMES) -> str:
    return _with(f"""{frames},
per_sample AS (SELECT trace_id, sample_ord, name, min(frame_pos) p FROM frames_named
               WHERE {where} GROUP BY ALL),
per_name AS (SELECT trace_id, name, count(*) "count", min(sample_ord * 1000 + p) seen
             FROM per_sample GROUP BY ALL),
best AS (SELECT *, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY "count" DESC, seen)
                        AS INTEGER) pos FROM per_name QUALIFY pos <= 30)""",
                 f"""SELECT trace_id, pos, name, split_part(name, '(', 1) short_name, "count",
       "count" / sample_count * 100 percent {extra}
FROM best JOIN totals USING (trace_id)""")


_RUNTIME = "<runtime method>.<runtime internal callee-save reference registers method>"


def _hot(frames: str) -> str:
    return _with(f"""{frames},
heads AS (SELECT trace_id, sample_ord, list(name ORDER BY frame_pos) names FROM frames_named
          WHERE frame_pos < 5 GROUP BY ALL),
per_stack AS (SELECT trace_id, names, count(*) "count", min(sample_ord) seen FROM heads GROUP BY ALL),
best AS (SELECT *, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY "count" DESC, seen)
                        AS INTEGER) pos FROM per_stack QUALIFY pos <= 15)""", """
SELECT trace_id, pos, array_to_string(names, '|') stack,
  array_to_string(list_transform(names, lambda x: split_part(x, '(', 1)), chr(10)) short_stack,
  "count", "count" / sample_count * 100 percent FROM best JOIN totals USING (trace_id)""")


def oracle_sql() -> dict[str, str]:
    sql = {
        "slice_scan": _with(_SLICE, "SELECT * FROM slice"),
        "main_thread_slices": _with(
            _SLICE,
            f"SELECT trace_id, id, track_id, parent_id, name, ts, dur FROM joined WHERE {_MAIN}",
        ),
        "framework_excluded": _with(
            _SLICE, f"SELECT trace_id, id, name FROM slice WHERE {_APP_CODE}"
        ),
        "long_slices": _one("long_slices", _LONG),
        "frame_jank": _one("frame_jank", _JANK),
        "main_thread_io": _one("main_thread_io", _IOHITS),
        "cpu_heavy": _one("cpu_heavy", _CPU),
        "long_slices_unfiltered": _variant("long", _MAIN_NAME_PID, 30),
        "frame_jank_undeduped": _variant(
            "jank", f"{_MAIN_NAME_FLAG} AND {_FRAME} AND dur > 16600000", 20
        ),
        "frame_jank_literal": _variant(
            "jank",
            f"{_MAIN_NAME_FLAG} AND name ILIKE '%doFrame%' OR name ILIKE '%Choreographer%' "
            "OR name ILIKE '%traversal%' AND dur > 16600000",
            20,
        ),
        "main_thread_io_undeduped": _variant("io", f"{_MAIN_NAME_FLAG} AND {_IO}", 20),
        "cpu_heavy_all_threads": _one("cpu_all", _cpu("cpu_all", "slice", "true")),
        "trace_status": _with(_SLICE, """
SELECT trace_id, bool_or(has) AS ready,
       CASE WHEN NOT bool_or(has) THEN '请先在 Perfetto 中加载 trace 文件' END AS error
FROM (SELECT trace_id, false has FROM thread UNION ALL SELECT trace_id, false FROM process
      UNION ALL SELECT trace_id, true FROM slice) GROUP BY trace_id"""),
        "dedup_slices": _with(_SLICE, f"""
SELECT trace_id, ts, dur, min(id) id, arg_min(name, id) AS name FROM joined
WHERE {_MAIN} GROUP BY trace_id, ts, dur"""),
        "is_io_related": _with(_SLICE, """
SELECT trace_id, id, name, coalesce(name LIKE '%Binder%' OR name LIKE '%sqlite%'
  OR name LIKE '%SharedPreferences%' OR name LIKE '%File%' OR name LIKE '%network%'
  OR name LIKE '%http%', false) is_io FROM slice"""),
        "longest_slice_by_keyword": _with(_SLICE, """
SELECT trace_id, id, coalesce(parent_id, -1) parent_id, name, ts, dur FROM slice
WHERE name ILIKE '%submit%'
QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY dur DESC, id) = 1"""),
        "diagnostic_counts": _with(_FOUR, " UNION ALL ".join(
            f"SELECT trace_id, '{d}' diagnostic, count(*) AS \"rows\" FROM {d} GROUP BY trace_id"
            for d in ("long_slices", "frame_jank", "cpu_heavy", "main_thread_io"))),
        "stack_seeds": _with(_FOUR, """
SELECT trace_id, id slice_id FROM long_slices UNION SELECT trace_id, id FROM frame_jank
UNION SELECT trace_id, id FROM main_thread_io"""),
        "call_stacks": _with(f"""{_FOUR}, all_seeds AS (
SELECT trace_id, id slice_id FROM long_slices UNION SELECT trace_id, id FROM frame_jank
UNION SELECT trace_id, id FROM main_thread_io), {_stack('all_seeds')}""", _STACK_SELECT, True),
        "call_stack_annotated": _with(f"""{_FOUR}, all_seeds AS (
SELECT trace_id, id slice_id FROM long_slices UNION SELECT trace_id, id FROM frame_jank
UNION SELECT trace_id, id FROM main_thread_io), {_stack('all_seeds', True)}""", _STACK_SELECT, True),
        "findings_roundtrip": _with(_FOUR, """
SELECT trace_id, kind, pos, id, name, dur_ms, ts, dur, NULL::BIGINT "count",
       NULL::DOUBLE total_ms, NULL::DOUBLE avg_ms FROM long_slices WHERE dur > 50000000
UNION ALL SELECT trace_id, kind, pos, id, name, dur_ms, ts, dur, NULL, NULL, NULL FROM frame_jank
UNION ALL SELECT trace_id, kind, pos, id, name, dur_ms, ts, dur, NULL, NULL, NULL
FROM main_thread_io WHERE dur > 50000000
UNION ALL SELECT trace_id, kind, pos, NULL, name, NULL, NULL, NULL, "count", total_ms, avg_ms
FROM cpu_heavy"""),
        "call_stack_by_keyword": _with(f"""{_SLICE}, kw AS (
SELECT trace_id, id slice_id FROM slice WHERE name ILIKE '%submit%'
QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY dur DESC, id) = 1), {_stack('kw')}""",
                                       _STACK_SELECT, True),
        "call_stack_text": _with(f"""{_SLICE}, every AS (
SELECT trace_id, id slice_id FROM slice), {_stack('every')}""",
                                 _STACK_SELECT, True),
        "severity": _with(_SLICE, f"""
SELECT trace_id, id, {_SEVERITY.format('dur / 1e6')} severity,
  CASE WHEN dur / 1e6 > 500 THEN 0 WHEN dur / 1e6 > 200 THEN 1 WHEN dur / 1e6 > 100 THEN 2
       ELSE 3 END severity_rank FROM slice"""),
        "issue_text": _with(f"{_FOUR}, {_COUNTED}", f"""
SELECT trace_id, kind, pos, raw duration_raw, {_TEXT_COLUMNS} FROM counted"""),
        "issues": _with(_ISSUES, "SELECT * FROM issues", True),
        "issues_roundtrip": _with(_ISSUES, "SELECT * FROM issues", True),
        "severity_counts": _with(f"{_FOUR}, {_RATED}, {_COUNTS}", "SELECT * FROM counts"),
        "issue_listing": _with(f"{_FOUR}, {_RATED}", """
SELECT trace_id, "position", '[' || severity || '] ' || name AS label,
       '耗时: ' || duration AS duration,
       CASE WHEN ts IS NOT NULL THEN 'locate' ELSE 'aggregated' END badge FROM rated"""),
        "focus_window": _with(f"{_FOUR}, {_RATED}", " UNION ALL ".join(
            _windows(p) for p in ("tenth", "third", "none"))),
        "issue_context": _with(f"{_FOUR}, {_RATED}, w AS ({_windows('tenth')})", """
SELECT w.trace_id, w."position", w.kind, w.id, count(*) slice_count,
  CAST(sum(least(s.ts + s.dur, window_start + window_width) - greatest(s.ts, window_start))
       AS BIGINT) overlap_ns,
  max(s.dur) longest_ns, min(s.ts) first_ts
FROM w JOIN slice s ON s.trace_id = w.trace_id AND s.ts < window_start + window_width
  AND s.ts + s.dur > window_start GROUP BY ALL"""),
        "report_summary": _with(f"{_FOUR}, {_RATED}, {_COUNTS}, {_SUMMARY}",
                                "SELECT * FROM summary"),
        "report": _with(_REPORT, "SELECT * FROM report", True),
        "report_sink": _with(_REPORT, """SELECT trace_id, markdown,
'perfetto_analysis_report_20240115_103045.md' file_name FROM report""", True),
        "report_filename": """
SELECT event_id, 'perfetto_analysis_report_' || strftime(ts, '%Y%m%d_%H%M%S') || '.md' file_name
FROM events""",
        "trace_id_from_path": """
SELECT page_id, CASE WHEN page_id % 3 = 0
  THEN 'analysis_' || strftime(TIMESTAMP '2024-03-05 08:05:03' + to_seconds(page_id), '%Y%m%d_%H%M%S')
  ELSE 'strace_a' || page_id || '_huawei' END trace_id FROM pages""",
        "annotate_methods": _with(rf"""{_SLICE}, {_SAMPLES}, methods AS (
SELECT name FROM slice UNION SELECT name FROM mapping),
noted AS (SELECT name, {_note('name')} note FROM methods)""",
            "SELECT name, note, CASE WHEN note <> '' THEN name || ' ' || note ELSE name END annotated FROM noted"),
        "pattern_tags": _with(f"""{_SLICE}, {_SAMPLES}, methods AS (
SELECT name FROM slice UNION SELECT name FROM mapping)""", r"""
SELECT name, tag, advice FROM methods JOIN (VALUES
  ('idle', 'MessageQueue\.next', 'Normal idle state'),
  ('json', 'JSONObject\.put|ReflectiveTypeAdapterFactory', 'Use code-gen (Moshi, kotlinx.serialization)'),
  ('reflection', 'java\.lang\.reflect\.', 'Use code generation'),
  ('io', '(?i)file|network|http', 'Move to background thread'),
  ('vendor_sdk', '(?i)vivo|huawei', 'Disable or reduce frequency'),
  ('database', '(?i)androidx\.room\.|sqlite', 'Optimize query frequency'),
  ('animation', '(?i)choreographer|vsync', 'Keep frame callbacks light'),
  ('logging', 'FilePrinter', 'Async batch logging')) r(tag, pattern, advice)
ON regexp_matches(name, pattern)"""),
        "sample_count": _with(_FRAMES, "SELECT * FROM totals"),
        "symbolized_frames": _with(_FRAMES, "SELECT * FROM frames_named"),
        "short_name": _with(_SAMPLES, """
SELECT addr, name, split_part(name, '(', 1) short_name, '0x' || lower(to_hex(addr)) addr_hex
FROM mapping"""),
        "self_time": _methods("frame_pos = 0"),
        "self_time_no_runtime": _methods(f"frame_pos = 0 AND name <> '{_RUNTIME}'"),
        "self_time_est_ms": _methods("frame_pos = 0", ", \"count\" * 25000 / 1000 est_ms"),
        "self_time_from_files": _methods(
            "frame_pos = 0", ", \"count\" * 25000 / 1000 est_ms", _FILE_FRAMES
        ),
        "self_time_from_folder": _methods(
            "frame_pos = 0", ", \"count\" * 25000 / 1000 est_ms", _FILE_FRAMES
        ),
        "inclusive_time_from_folder": _methods("true", "", _FILE_FRAMES),
        "hot_stacks_from_folder": _hot(_FILE_FRAMES),
        "self_time_from_parts": _methods("frame_pos = 0"),
        "inclusive_time_from_parts": _methods("true"),
        "hot_stacks_from_parts": _hot(_FRAMES),
        "self_time_from_store": _methods("frame_pos = 0"),
        "inclusive_time": _methods("true"),
        "hot_stacks": _hot(_FRAMES),
        "parse_samples": _with(_SAMPLES, """
SELECT trace_id || '-' || block trace_id,
  row_number() OVER (PARTITION BY trace_id, block ORDER BY sample_ord) - 1 sample_ord,
  2 AS marker, CAST(len(frames) AS INTEGER) AS depth, array_to_string(frames, ',') frames
FROM samples WHERE block % 7 <> 3 AND block % 9 <> 4"""),
        "parse_stats": _with(_SAMPLES, """
SELECT trace_id || '-' || block trace_id,
  CASE WHEN block % 9 = 4 THEN 0 ELSE count(*) END sample_count,
  CAST(CASE WHEN block % 9 = 4 THEN 201 WHEN block % 4 = 1 THEN 10 ELSE 0 END AS BIGINT) bad
FROM samples WHERE block % 7 <> 3 GROUP BY trace_id, block"""),
        "trace_header": _with(_SAMPLES, """
SELECT DISTINCT trace_id || '-' || block trace_id, CAST(5 AS BIGINT) AS version,
  block * 1000000 ts, CAST(25000 AS BIGINT) interval_us,
  '{"processId":' || (block + 1000) || '}' meta, block + 1000 process_id FROM samples"""),
        "valid_trace_files": _with(_SAMPLES, """
SELECT DISTINCT trace_id || '-' || block trace_id, block % 7 <> 3 AS valid,
  CASE WHEN block % 7 = 3 THEN 'deadbeef' END signature FROM samples"""),
        "parse_mapping": _with(_SAMPLES, """
SELECT 'm' || (addr // 1000) trace_id, addr, name FROM mapping"""),
        "mapping_json_roundtrip": _with(_SAMPLES, "SELECT addr, name FROM mapping"),
    }
    sql["diagnostic_counts_broken_trace"] = _with(_FOUR, " UNION ALL ".join(
        f"SELECT trace_id, '{d}' diagnostic, count(*) AS \"rows\" FROM {d} {where} GROUP BY trace_id"
        for d, where in (("long_slices", ""), ("frame_jank", "WHERE trace_id <> 't1'"),
                         ("cpu_heavy", ""), ("main_thread_io", "")))
        + " UNION ALL SELECT 't1', 'frame_jank', NULL")
    # the same results through other readers
    sql["parse_samples_by_range"] = sql["parse_samples"]
    sql["parse_stats_by_range"] = sql["parse_stats"]
    sql["trace_header_listed"] = sql["trace_header"] + " WHERE block % 7 <> 3"
    sql["valid_trace_files_listed"] = sql["valid_trace_files"]
    return sql

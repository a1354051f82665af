"""DuckDB SQL with the same results as the registered queries.

The greedy recurrences are recursive common table expressions that follow one
pointer per step: from each time to the first one at least a gap later.
"""

from __future__ import annotations

WINDOW_3D = 259_200 * 1_000_000
SHORT_WINDOW = 6 * 3600 * 1_000_000
COOLDOWN = 604_800 * 1_000_000
ARP_COOLDOWN = 432_000 * 1_000_000
ANOMALY_WINDOW = 900 * 1_000_000
HOUR = 3_600 * 1_000_000
# Ten days of the given events.
RANGE = (1_704_844_800_000_000, 1_705_708_800_000_000)

PACKETS = r"""
packets AS MATERIALIZED (
  SELECT event_id AS seq, epoch_us(ts) AS ts_us, user_id,
         '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS plain_ip,
         CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 101 = 1 THEN ''
              WHEN event_id % 101 = 2 AND event_type = 'signup' THEN '0.0.0.0'
              WHEN event_id % 101 = 3 THEN '2001:db8::5' WHEN event_id % 101 = 4 THEN '2001:DB9:0::5'
              ELSE '10.0.' || (user_id // 256) || '.' || (user_id % 256) END AS src_ip,
         CASE WHEN event_type = 'signup' THEN 'aa:aa:aa:aa:aa:0' || (k % 3) ELSE 'bb:bb:bb:bb:bb:bb' END AS src_mac,
         CASE event_type WHEN 'view' THEN 'UDP' WHEN 'signup' THEN 'ARP' ELSE 'TCP' END AS protocol,
         k, 1000 + k AS dst_port,
         CASE WHEN event_type IN ('click', 'error') THEN 'S' WHEN event_type = 'purchase' THEN 'SA' END AS tcp_flags,
         event_type = 'signup' AS is_arp
  FROM (SELECT *, CAST(regexp_extract(props, '\d+') AS INTEGER) AS k FROM events)
)"""

# Sources of the whitelist 10.0.0.3, 10.0.0.8/30 and 2001:db8::/32.
TRUSTED = "coalesce(src_ip IN ('10.0.0.3', '10.0.0.8', '10.0.0.9', '10.0.0.10', '10.0.0.11', '2001:db8::5'), false)"
SCAN_ROW = "protocol IN ('TCP', 'UDP') AND src_ip <> ''"
SYN_ROW = "protocol = 'TCP' AND tcp_flags = 'S' AND src_ip <> ''"
ARP_ROW = "is_arp AND src_ip <> '' AND src_ip <> '0.0.0.0'"


def _iso(ts_us: str) -> str:
    return (
        f"strftime(make_timestamp({ts_us}), '%Y-%m-%dT%H:%M:%S') || "
        f"CASE WHEN {ts_us} % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST({ts_us} % 1000000 AS VARCHAR), 6, '0') END || '+00:00'"
    )


def _debounced(name: str, candidates: str, gap: int, forced: bool = False) -> str:
    """CTE ``name``: the rows of ``candidates`` that fire. Times are distinct per source in the given data."""
    must = (
        f"""{name}_forced AS (SELECT src_ip, ts_us FROM {candidates} WHERE first_seen),"""
        if forced
        else ""
    )
    must_join = (
        f"ASOF LEFT JOIN {name}_forced f ON c.src_ip = f.src_ip AND c.ts_us + 1 <= f.ts_us" if forced else ""
    )
    following = "least(coalesce(d.ts_us, f.ts_us), coalesce(f.ts_us, d.ts_us))" if forced else "d.ts_us"
    return f"""
{must}
{name}_next AS MATERIALIZED (
  SELECT c.src_ip, c.ts_us, {following} AS next_us
  FROM {candidates} c ASOF LEFT JOIN {candidates} d ON c.src_ip = d.src_ip AND c.ts_us + {gap} <= d.ts_us {must_join}
),
{name}_chain AS (
  SELECT src_ip, min(ts_us) AS ts_us FROM {candidates} GROUP BY src_ip
  UNION ALL
  SELECT n.src_ip, n.next_us FROM {name}_chain h JOIN {name}_next n ON h.src_ip = n.src_ip AND h.ts_us = n.ts_us
  WHERE n.next_us IS NOT NULL
),
{name} AS MATERIALIZED (SELECT c.* FROM {candidates} c JOIN {name}_chain h ON c.src_ip = h.src_ip AND c.ts_us = h.ts_us)"""


def _frame(window: int) -> str:
    return f"PARTITION BY src_ip ORDER BY ts_us RANGE BETWEEN {window} PRECEDING AND CURRENT ROW"


def _port_scan(source: str = "packets", p: str = "", least: int = 8) -> str:
    return f"""
{p}scan_rows AS MATERIALIZED (SELECT seq, ts_us, src_ip, dst_port FROM {source} WHERE {SCAN_ROW}),
{p}scan_over AS MATERIALIZED (
  SELECT * FROM (SELECT seq, ts_us, src_ip, count(DISTINCT dst_port) OVER ({_frame(WINDOW_3D)}) AS observed FROM {p}scan_rows)
  WHERE observed >= {least}
),
{_debounced(p + "scan", p + "scan_over", COOLDOWN)},
{p}scan_alerts AS MATERIALIZED (
  SELECT a.seq, a.ts_us, a.src_ip AS source_ip, 'PORT_SCAN' AS event_type, a.observed,
         a.observed || ' distinct ports contacted within 259200s (threshold: {least}); recent ports: ['
         || array_to_string(list_sort(list(DISTINCT r.dst_port))[1:20], ', ') || ']' AS details
  FROM {p}scan a JOIN {p}scan_rows r ON r.src_ip = a.src_ip AND r.ts_us BETWEEN a.ts_us - {WINDOW_3D} AND a.ts_us
  GROUP BY a.seq, a.ts_us, a.src_ip, a.observed
)"""


def _arp_spoof(source: str = "packets", p: str = "") -> str:
    return f"""
{p}arp_rows AS MATERIALIZED (
  SELECT seq, ts_us, src_ip, src_mac, row_number() OVER (PARTITION BY src_ip, src_mac ORDER BY ts_us, seq) = 1 AS first_seen
  FROM {source} WHERE {ARP_ROW}
),
{p}arp_counted AS MATERIALIZED (
  SELECT *, CAST(sum(CAST(first_seen AS INTEGER)) OVER (PARTITION BY src_ip ORDER BY ts_us, seq) AS BIGINT) AS observed FROM {p}arp_rows
),
{p}arp_over AS MATERIALIZED (SELECT * FROM {p}arp_counted WHERE observed >= 2),
{_debounced(p + "arp", p + "arp_over", ARP_COOLDOWN, forced=True)},
{p}arp_alerts AS MATERIALIZED (
  SELECT a.seq, a.ts_us, a.src_ip AS source_ip, 'ARP_SPOOF' AS event_type, a.observed,
         'IP ' || a.src_ip || ' is associated with ' || a.observed || ' MAC addresses: ['''
         || array_to_string(list_sort(list(DISTINCT r.src_mac)), ''', ''') || ''']' AS details
  FROM {p}arp a JOIN {p}arp_rows r ON r.src_ip = a.src_ip AND r.ts_us <= a.ts_us
  GROUP BY a.seq, a.ts_us, a.src_ip, a.observed
)"""


def _syn_flood(source: str = "packets", p: str = "", least: int = 6) -> str:
    return f"""
{p}syn_rows AS MATERIALIZED (SELECT seq, ts_us, src_ip FROM {source} WHERE {SYN_ROW}),
{p}syn_over AS MATERIALIZED (
  SELECT * FROM (SELECT *, count(*) OVER ({_frame(WINDOW_3D)}) AS observed FROM {p}syn_rows) WHERE observed >= {least}
),
{_debounced(p + "syn", p + "syn_over", COOLDOWN)},
{p}syn_alerts AS MATERIALIZED (
  SELECT seq, ts_us, src_ip AS source_ip, 'SYN_FLOOD' AS event_type, observed,
         observed || ' SYN packets within 259200s (~' || printf('%.1f', observed / 259200.0) || ' SYN/s, threshold: {least})' AS details,
         CAST(observed AS DOUBLE) / 259200.0::DOUBLE AS rate
  FROM {p}syn
)"""


def _windows(source: str = "packets", p: str = "") -> str:
    return f"""
{p}times AS MATERIALIZED (SELECT DISTINCT ts_us FROM {source}),
{p}time_next AS MATERIALIZED (
  SELECT a.ts_us, b.ts_us AS next_us FROM {p}times a ASOF JOIN {p}times b ON a.ts_us + {ANOMALY_WINDOW} <= b.ts_us
),
{p}starts AS (
  SELECT min(ts_us) AS window_start FROM {p}times
  UNION ALL
  SELECT n.next_us FROM {p}starts s JOIN {p}time_next n ON n.ts_us = s.window_start
),
{p}members AS MATERIALIZED (
  SELECT m.seq, m.ts_us, m.src_ip, s.window_start
  FROM {source} m ASOF JOIN (SELECT DISTINCT window_start FROM {p}starts) s ON m.ts_us >= s.window_start
),
{p}windows AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY window_start) - 1 AS window_id, window_start, n, first_seq,
         lead(window_start) OVER (ORDER BY window_start) AS close_us, lead(first_seq) OVER (ORDER BY window_start) AS close_seq
  FROM (SELECT window_start, count(*) AS n, arg_min(seq, ts_us) AS first_seq FROM {p}members GROUP BY window_start)
),
{p}baseline AS MATERIALIZED (
  SELECT *, avg(n) OVER w AS baseline_avg, count(n) OVER w AS baseline_n
  FROM {p}windows WINDOW w AS (ORDER BY window_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)
),
{p}tops AS MATERIALIZED (
  SELECT w.window_start, coalesce(t.src_ip, 'unknown') AS top_ip, coalesce(t.top_count, 0) AS top_count
  FROM {p}windows w LEFT JOIN (
    SELECT window_start, src_ip, count(*) AS top_count,
           row_number() OVER (PARTITION BY window_start ORDER BY count(*) DESC, min(ts_us), min(seq)) AS place
    FROM {p}members WHERE src_ip <> '' GROUP BY window_start, src_ip) t
  ON t.window_start = w.window_start AND t.place = 1
)"""


def _traffic_anomaly(source: str = "packets", p: str = "") -> str:
    return f"""
{_windows(source, p)},
{p}anomaly_alerts AS MATERIALIZED (
  SELECT b.close_seq AS seq, b.close_us AS ts_us, t.top_ip AS source_ip, 'TRAFFIC_ANOMALY' AS event_type, b.n AS observed,
         b.n || ' packets in 900s window exceeds 2.0x baseline average (' || printf('%.1f', b.baseline_avg)
         || ' packets); top source: ' || t.top_ip || ' (' || t.top_count || ' packets)' AS details,
         2.0::DOUBLE * b.baseline_avg AS threshold
  FROM {p}baseline b JOIN {p}tops t USING (window_start)
  WHERE b.close_us IS NOT NULL AND b.baseline_n >= 3 AND b.baseline_avg > 0 AND b.n > 2.0::DOUBLE * b.baseline_avg
)"""


VIEW = "seq, ts_us, source_ip, event_type, observed, details"


def _all(source: str = "packets", p: str = "", ports: int = 8, syns: int = 6) -> str:
    return f"""
{_port_scan(source, p, ports)},
{_arp_spoof(source, p)},
{_syn_flood(source, p, syns)},
{_traffic_anomaly(source, p)},
{p}alerts AS MATERIALIZED (
  SELECT {VIEW}, 0 AS detector_ordinal, 0 AS batch FROM {p}scan_alerts
  UNION ALL SELECT {VIEW}, 1, 1 FROM {p}arp_alerts
  UNION ALL SELECT {VIEW}, 2, 0 FROM {p}syn_alerts
  UNION ALL SELECT {VIEW}, 3, 1 FROM {p}anomaly_alerts
),
{p}log AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY batch, seq, detector_ordinal) AS id, {VIEW} FROM {p}alerts
)"""


def _sql(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {PACKETS}{',' if ctes else ''}{ctes}\n{select}"


# What the frame of an event holds after the special cases of the frame projection.
FRAMES = """
frames AS MATERIALIZED (
  SELECT *, CASE WHEN is_arp THEN 42 WHEN k = 93 THEN 54
                 ELSE 34 + CASE WHEN k = 95 THEN 4 WHEN protocol = 'UDP' THEN 8 ELSE 20 END + CASE WHEN k = 94 THEN 4 ELSE 0 END
            END AS whole
  FROM packets
),
decoded AS MATERIALIZED (
  SELECT *, CASE k WHEN 96 THEN least(10, whole) WHEN 97 THEN least(30, whole) ELSE whole END AS size,
         NOT is_arp AND k = 93 AS is_ipv6,
         NOT is_arp AND k NOT IN (90, 91, 92, 93, 95) AS has_ports
  FROM frames
)"""

ORACLE: dict[str, str] = {
    "packets": _sql(
        "",
        f"SELECT seq, ts_us, {_iso('ts_us')} AS event_time, src_ip, src_mac, protocol, dst_port, tcp_flags, is_arp, 0 AS length FROM packets",
    ),
    "decode_frames": _sql(
        FRAMES,
        """SELECT seq, CASE WHEN NOT is_ipv6 THEN plain_ip END AS src_ip, CASE WHEN NOT is_ipv6 THEN '10.0.0.2' END AS dst_ip,
                  src_mac, CASE WHEN is_arp THEN 'cc:cc:cc:cc:cc:cc' ELSE 'dd:dd:dd:dd:dd:dd' END AS dst_mac,
                  CASE WHEN is_arp THEN 'ARP' WHEN is_ipv6 THEN NULL WHEN has_ports THEN protocol ELSE 'IP' END AS protocol,
                  CASE WHEN has_ports THEN CASE protocol WHEN 'UDP' THEN 53 ELSE 12345 END END AS src_port,
                  CASE WHEN has_ports THEN dst_port END AS dst_port,
                  CASE WHEN has_ports AND protocol = 'TCP' THEN tcp_flags END AS tcp_flags,
                  is_arp, CASE WHEN is_arp THEN 2 END AS arp_op, size AS length
           FROM decoded WHERE k NOT IN (96, 97)""",
    ),
    "capture_filter": _sql(
        FRAMES, "SELECT seq, size AS length FROM decoded WHERE k <> 96 AND (is_arp OR k NOT IN (93, 94))"
    ),
    "quarantine": _sql(
        FRAMES,
        """SELECT seq, size AS length,
                  CASE WHEN k = 96 THEN 'short link header' WHEN is_arp THEN 'bad ARP body' ELSE 'bad IPv4 header' END AS decode_error
           FROM decoded WHERE k IN (96, 97)""",
    ),
    "syn_packets": _sql("", f"SELECT seq, src_ip, tcp_flags FROM packets WHERE {SYN_ROW}"),
    "port_scan_eligible": _sql("", f"SELECT seq, src_ip, protocol, dst_port FROM packets WHERE {SCAN_ROW}"),
    "arp_eligible": _sql("", f"SELECT seq, src_ip, src_mac FROM packets WHERE {ARP_ROW}"),
    "whitelist_filter": _sql("", f"SELECT seq, src_ip FROM packets WHERE NOT {TRUSTED}"),
    "sliding_syn_count": _sql(
        "",
        f"SELECT seq, src_ip, ts_us, count(*) OVER ({_frame(SHORT_WINDOW)}) AS observed FROM packets WHERE {SYN_ROW}",
    ),
    "sliding_syn_count_3d": _sql(
        "",
        f"SELECT seq, src_ip, ts_us, count(*) OVER ({_frame(WINDOW_3D)}) AS observed FROM packets WHERE {SYN_ROW}",
    ),
    "sliding_distinct_ports": _sql(
        "",
        f"SELECT seq, src_ip, ts_us, count(DISTINCT dst_port) OVER ({_frame(SHORT_WINDOW)}) AS observed FROM packets WHERE {SCAN_ROW}",
    ),
    "sliding_distinct_ports_3d": _sql(
        "",
        f"SELECT seq, src_ip, ts_us, count(DISTINCT dst_port) OVER ({_frame(WINDOW_3D)}) AS observed FROM packets WHERE {SCAN_ROW}",
    ),
    "arp_bindings": _sql(_arp_spoof(), "SELECT src_ip, src_mac, ts_us, seq, observed, first_seen FROM arp_counted"),
    "cooldown": _sql(_syn_flood(), "SELECT seq, src_ip, ts_us, observed FROM syn"),
    "anchored_windows": _sql(_windows(), "SELECT * FROM windows"),
    "rolling_baseline": _sql(_windows(), "SELECT window_id, window_start, n, baseline_avg, baseline_n FROM baseline"),
    "top_source_per_window": _sql(_windows(), "SELECT * FROM tops"),
    "port_scan": _sql(_port_scan(), f"SELECT {VIEW} FROM scan_alerts"),
    "arp_spoof": _sql(_arp_spoof(), f"SELECT {VIEW} FROM arp_alerts"),
    "syn_flood": _sql(_syn_flood(), f"SELECT {VIEW}, rate FROM syn_alerts"),
    "traffic_anomaly": _sql(_traffic_anomaly(), f"SELECT {VIEW}, threshold FROM anomaly_alerts"),
    "selected_detectors": _sql(
        f"{_port_scan()},{_syn_flood()}",
        f"SELECT {VIEW}, 0 AS detector_ordinal FROM scan_alerts UNION ALL SELECT {VIEW}, 2 FROM syn_alerts",
    ),
    "detect_all": _sql(_all(), f"SELECT {VIEW} FROM alerts"),
    "detect_all_whitelisted": _sql(
        f"watched AS MATERIALIZED (SELECT * FROM packets WHERE NOT {TRUSTED}),{_all('watched')}", f"SELECT {VIEW} FROM alerts"
    ),
    "alert_ids": _sql(_all(), "SELECT row_number() OVER (ORDER BY seq, detector_ordinal) AS id, seq, event_type FROM alerts"),
    "fault_isolation": _sql(
        f"{_port_scan()},{_syn_flood()}",
        """SELECT event_type, count(*) AS alerts, 'broken' AS failed_detectors
           FROM (SELECT event_type FROM scan_alerts UNION ALL SELECT event_type FROM syn_alerts) GROUP BY event_type""",
    ),
    "session_summary": _sql(
        f"watched AS MATERIALIZED (SELECT * FROM packets WHERE NOT {TRUSTED}),{_all('watched')}",
        "SELECT (SELECT count(*) FROM packets) AS packets, (SELECT count(*) FROM alerts) AS alerts",
    ),
    "alert_log": _sql(_all(), f"SELECT id, {VIEW} FROM log"),
    "alert_lines": _sql(_all(), "SELECT id, 'ALERT [' || event_type || '] source=' || source_ip || ' :: ' || details AS line FROM log"),
    "alert_text": _sql(_all(), "SELECT 'ALERT [' || event_type || '] source=' || source_ip || ' :: ' || details AS line FROM alerts"),
    "events_by_type": _sql(_all(), f"SELECT id, {VIEW} FROM log WHERE event_type = 'SYN_FLOOD'"),
    "events_by_source": _sql(_all(), f"SELECT id, {VIEW} FROM log WHERE source_ip = '10.0.0.7'"),
    "recent_events": _sql(_all(), f"SELECT id, {VIEW} FROM log ORDER BY id DESC LIMIT 100"),
    "recent_events_filtered": _sql(
        _all(),
        f"SELECT id, {VIEW} FROM log WHERE event_type = 'ARP_SPOOF' AND source_ip = '10.0.0.7' ORDER BY id DESC LIMIT 5",
    ),
    "recent_events_capped": _sql(_all(), f"SELECT id, {VIEW} FROM log ORDER BY id DESC LIMIT 1000"),
    "newest_events": _sql(_all(), f"SELECT id, {VIEW} FROM log ORDER BY id DESC LIMIT 100"),
    "newest_events_filtered": _sql(
        _all(),
        f"SELECT id, {VIEW} FROM log WHERE event_type = 'ARP_SPOOF' AND source_ip = '10.0.0.7' ORDER BY id DESC LIMIT 5",
    ),
    "event_count": _sql(_all(), "SELECT count(*) AS total_events FROM log"),
    "events_per_type": _sql(_all(), "SELECT event_type, count(*) AS n FROM log GROUP BY event_type"),
    "stats": _sql(
        _all(),
        """SELECT CAST(sum(n) AS BIGINT) AS total_events, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS by_type
           FROM (SELECT event_type, count(*) AS n FROM log GROUP BY event_type)""",
    ),
    "events_json": _sql(
        _all(),
        f"""SELECT id, '{{"id":' || id || ',"timestamp":"' || {_iso('ts_us')} || '","source_ip":"' || source_ip || '","event_type":"'
               || event_type || '","details":"' || details || '"}}' AS json FROM log""",
    ),
    "type_cards": _sql(
        _all(),
        """SELECT card, CAST(coalesce(n, 0) AS BIGINT) AS n
           FROM (VALUES ('TOTAL'), ('PORT_SCAN'), ('ARP_SPOOF'), ('SYN_FLOOD'), ('TRAFFIC_ANOMALY')) c(card)
           LEFT JOIN (SELECT event_type, count(*) AS n FROM log GROUP BY event_type
                      UNION ALL SELECT 'TOTAL', count(*) FROM log) t ON t.event_type = c.card""",
    ),
    "stream_port_scan": _sql(_port_scan(), f"SELECT {VIEW} FROM scan_alerts"),
    "stream_arp_spoof": _sql(_arp_spoof(), f"SELECT {VIEW} FROM arp_alerts"),
    "stream_syn_flood": _sql(_syn_flood(), f"SELECT {VIEW} FROM syn_alerts"),
    "stream_traffic_anomaly": _sql(_traffic_anomaly(), f"SELECT {VIEW} FROM anomaly_alerts"),
    "stream_port_scan_late": _sql(_port_scan(), f"SELECT {VIEW} FROM scan_alerts"),
    "stream_arp_spoof_late": _sql(_arp_spoof(), f"SELECT {VIEW} FROM arp_alerts"),
    "stream_syn_flood_late": _sql(_syn_flood(), f"SELECT {VIEW} FROM syn_alerts"),
    "stream_traffic_anomaly_late": _sql(_traffic_anomaly(), f"SELECT {VIEW} FROM anomaly_alerts"),
    "stream_detect_all": _sql(
        _all(), f"SELECT row_number() OVER (ORDER BY seq, detector_ordinal) AS id, {VIEW} FROM alerts"
    ),
    "stream_summary": _sql(
        f"watched AS MATERIALIZED (SELECT * FROM packets WHERE NOT {TRUSTED}),{_all('watched')}",
        "SELECT (SELECT count(*) FROM packets) AS packets, (SELECT count(*) FROM alerts) AS alerts, 0::BIGINT AS late",
    ),
    # The replay has three micro-batches.
    "stream_fault_isolation": _sql(
        f"{_port_scan()},{_syn_flood()}",
        """SELECT event_type, count(*) AS alerts, 3::BIGINT AS failures, 'broken' AS failed_detectors
           FROM (SELECT event_type FROM scan_alerts UNION ALL SELECT event_type FROM syn_alerts) GROUP BY event_type""",
    ),
    "aligned_windows": _sql(
        "", f"SELECT ts_us - ts_us % {SHORT_WINDOW} AS window_start, count(*) AS n FROM packets GROUP BY 1"
    ),
    "arrival_numbers": _sql(
        "",
        f"""SELECT ts_us, n, first_seq, first_seq + n - 1 AS last_seq, n AS numbers FROM (
              SELECT ts_us, n, CAST(sum(n) OVER (ORDER BY ts_us) - n AS BIGINT) AS first_seq FROM (
                SELECT ts_us - ts_us % {HOUR} AS ts_us, count(*) AS n FROM packets GROUP BY 1))""",
    ),
    # At one time the counts only rise, so when a source alerts doesn't depend on the order of its packets of that time.
    "unnumbered_port_scan": _sql(
        f"""
hourly AS (SELECT src_ip, dst_port, ts_us - ts_us % {HOUR} AS ts_us FROM packets WHERE {SCAN_ROW}),
hourly_over AS MATERIALIZED (
  SELECT DISTINCT src_ip, ts_us FROM (SELECT *, count(DISTINCT dst_port) OVER ({_frame(WINDOW_3D)}) AS observed FROM hourly)
  WHERE observed >= 8
),
{_debounced("hourly_scan", "hourly_over", COOLDOWN)}""",
        "SELECT src_ip AS source_ip, ts_us, true AS listed FROM hourly_scan",
    ),
    # A run for each sensor.
    "detect_by_sensor": _sql(
        "".join(
            f"{',' if k else ''}sensor{k} AS MATERIALIZED (SELECT * FROM packets WHERE dst_port % 2 = {k}),{_all(f'sensor{k}', f's{k}_', 5, 4)}"
            for k in (0, 1)
        ),
        f"SELECT {VIEW}, 0 AS sensor_id FROM s0_alerts UNION ALL SELECT {VIEW}, 1 FROM s1_alerts",
    ),
    "packets_in_range": _sql("", f"SELECT seq, ts_us, src_ip FROM packets WHERE ts_us >= {RANGE[0]} AND ts_us < {RANGE[1]}"),
}

"""SQL of the level-interaction events: the detector's automaton as a recursive query.

Each row of the recursion is a decision on one path: ``seek`` looks for the next entry into a level's zone, ``hold`` follows a settled
interaction from one run of a side to the next. A decision may bring an event, a stretch of states, and where to go on.
"""

from __future__ import annotations

import re

from pricepanel.operators.events import NAMES, Rules

PATH = "segment_id, issue_id, source, path_id"
TABLES = "er|eq|el|ep|lv|si|sn|sr|rn|rx|sd|nr|en|sk|se|walk|wk|evx|ex|ee|ev|marks|trace"
STATES = "CASE WHEN {s} > 0 THEN 'up' ELSE 'down' END"


def paths_sql(horizon_pad: int = 0) -> str:
    """``ep``: the prices of each path in units of its window range, ``horizon_pad`` last prices appended, by index ``i``."""
    base = f"""er AS (SELECT {PATH}, step, row_number() OVER w - 1 AS i, last, first_value(lo) OVER w AS l0, first_value(hi) OVER w AS h0 FROM feats WINDOW w AS (PARTITION BY {PATH} ORDER BY step)),
  eq AS (SELECT {PATH}, step, i, (last - l0) / greatest(h0 - l0, 1e-8) AS price FROM er)"""
    if not horizon_pad:
        return f"{base}, ep AS (SELECT {PATH}, step, i, price FROM eq)"
    return f"""{base}, el AS (SELECT {PATH}, max(i) AS top, arg_max(price, i) AS price FROM eq GROUP BY ALL),
  ep AS (SELECT {PATH}, step, i, price FROM eq UNION ALL SELECT {PATH}, NULL, top + 1 + k, price FROM el, range({horizon_pad}) t(k))"""


def events_sql(rules: Rules, levels: tuple[float, ...], pad: int = 0, prefix: str = "") -> str:
    """CTEs up to ``ev`` (the events) and ``trace`` (the states) over ``feats``; ``prefix`` goes before their names."""
    sql = _events_sql(rules, levels, pad)
    return re.sub(rf"\b({TABLES})\b", rf"{prefix}\1", sql) if prefix else sql


def _events_sql(rules: Rules, levels: tuple[float, ...], pad: int) -> str:
    tol, dwell, conf, most = rules.tolerance, rules.min_dwell, rules.confirmation, rules.max_dwell
    fields = "kind, out_at, exit_at, dwell, stage, confirmed, m_from, m_to, m_state, m_last"
    none = "NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::BOOLEAN, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR"
    return f"""{paths_sql(pad)}, lv AS (SELECT unnest([{', '.join(map(str, levels))}]) AS level, unnest(range({len(levels)})) AS l),
  si AS (SELECT {PATH}, i, l, level, price, CASE WHEN price - level > {tol} THEN 1 WHEN price - level < -{tol} THEN -1 ELSE 0 END AS s, abs(price - level) AS gap FROM ep, lv),
  sn AS (SELECT *, lag(s) OVER w AS was, count(*) OVER (PARTITION BY {PATH}, l) AS n FROM si WINDOW w AS (PARTITION BY {PATH}, l ORDER BY i)),
  sr AS (SELECT *, sum((s IS DISTINCT FROM was)::INT) OVER (PARTITION BY {PATH}, l ORDER BY i) AS run FROM sn),
  rn AS (SELECT {PATH}, l, run, max(i) + 1 AS stop, any_value(s) AS s FROM sr GROUP BY ALL),
  rx AS (SELECT *, lead(s) OVER w AS next_s, lead(stop) OVER w AS next_stop FROM rn WINDOW w AS (PARTITION BY {PATH}, l ORDER BY run)),
  sd AS (SELECT sr.* EXCLUDE (run), rx.stop, rx.next_s, rx.next_stop FROM sr JOIN rx USING ({PATH}, l, run)),
  nr AS (SELECT *, row_number() OVER (PARTITION BY {PATH}, i ORDER BY gap, l) AS place FROM sd),
  en AS (SELECT {PATH}, i, l, level, was AS came, stop, next_s, next_stop, n FROM nr WHERE place = 1 AND s = 0 AND was <> 0),
  sk AS (SELECT a.segment_id, a.issue_id, a.source, a.path_id, a.i AS at_i, min(en.i) AS entry FROM ep a JOIN en ON a.segment_id = en.segment_id AND a.issue_id = en.issue_id AND a.source = en.source AND a.path_id = en.path_id AND en.i >= a.i GROUP BY ALL),
  se AS (SELECT {PATH}, at_i, entry, l, level, came, stop, next_s, next_stop, n FROM sk JOIN en USING ({PATH}) WHERE en.i = sk.entry),
  walk({PATH}, turn, phase, at_i, entry, l, level, came, settled, held, {fields}) AS (
    SELECT {PATH}, 0, 'seek', 1::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::INT, NULL::BIGINT, NULL::BIGINT, {none}
    FROM (SELECT DISTINCT {PATH} FROM ep)
    UNION ALL
    SELECT {PATH}, turn, phase, at_i, entry, l, level, came, settled, held, {fields} FROM (
      SELECT w.segment_id, w.issue_id, w.source, w.path_id, w.turn + 1 AS turn,
        CASE WHEN se.stop > se.entry + {dwell - 1} THEN 'hold' WHEN se.stop = se.n THEN 'end' WHEN se.next_s <> se.came THEN 'seek' WHEN se.stop + {conf - 1} >= se.n THEN 'end' ELSE 'seek' END AS phase,
        CASE WHEN se.stop > se.entry + {dwell - 1} THEN se.entry + {dwell} WHEN se.stop < se.n AND se.next_s <> se.came THEN se.stop WHEN se.next_stop > se.stop + {conf - 1} THEN se.stop + {conf} ELSE se.next_stop END AS at_i,
        se.entry, se.l, se.level, se.came, se.entry + {dwell - 1} AS settled, {dwell}::BIGINT AS held,
        CASE WHEN se.stop > se.entry + {dwell - 1} THEN 'HOVER' WHEN se.stop < se.n AND se.next_s = se.came AND se.stop + {conf - 1} < se.n AND se.next_stop > se.stop + {conf - 1} THEN 'PULLBACK' END AS kind,
        CASE WHEN se.stop > se.entry + {dwell - 1} THEN se.entry + {dwell - 1} ELSE se.stop + {conf - 1} END AS out_at,
        CASE WHEN se.stop > se.entry + {dwell - 1} THEN NULL ELSE se.stop END AS exit_at,
        CASE WHEN se.stop > se.entry + {dwell - 1} THEN {dwell} ELSE se.stop - se.entry END AS dwell,
        CASE WHEN se.stop > se.entry + {dwell - 1} THEN NULL ELSE 'approaching' END AS stage,
        se.stop <= se.entry + {dwell - 1} AS confirmed,
        se.entry AS m_from,
        CASE WHEN se.stop > se.entry + {dwell - 1} THEN se.entry + {dwell - 1} WHEN se.stop = se.n OR se.next_s <> se.came OR se.stop + {conf - 1} >= se.n THEN se.stop WHEN se.next_stop > se.stop + {conf - 1} THEN se.stop + {conf - 1} ELSE se.next_stop END AS m_to,
        'APPROACHING' AS m_state,
        CASE WHEN se.stop > se.entry + {dwell - 1} THEN 'CONSOLIDATING' WHEN se.stop < se.n AND se.next_s = se.came AND se.stop + {conf - 1} < se.n AND se.next_stop > se.stop + {conf - 1} THEN 'FINISHED' END AS m_last
      FROM walk w JOIN se ON w.segment_id = se.segment_id AND w.issue_id = se.issue_id AND w.source = se.source AND w.path_id = se.path_id AND w.at_i = se.at_i WHERE w.phase = 'seek'
      UNION ALL
      SELECT w.segment_id, w.issue_id, w.source, w.path_id, w.turn + 1,
        CASE c.act WHEN 'zone' THEN 'hold' WHEN 'wait' THEN 'hold' WHEN 'back' THEN 'hold' WHEN 'open' THEN 'end' ELSE 'seek' END,
        CASE c.act WHEN 'late' THEN w.settled + {most} + 1 WHEN 'zone' THEN least(sd.stop, w.settled + {most}) WHEN 'wait' THEN w.settled + {most} WHEN 'back' THEN sd.stop ELSE sd.i + {conf} END,
        w.entry, w.l, w.level, w.came, w.settled, w.held + CASE c.act WHEN 'zone' THEN least(sd.stop, w.settled + {most}) - sd.i ELSE 0 END,
        CASE c.act WHEN 'late' THEN 'TIMEOUT' WHEN 'out' THEN CASE WHEN sd.s = w.came THEN 'PULLBACK' ELSE 'BREAKOUT' END END,
        CASE c.act WHEN 'late' THEN w.settled + {most} ELSE sd.i + {conf - 1} END,
        CASE c.act WHEN 'late' THEN w.settled + {most} ELSE sd.i END, w.held, CASE WHEN c.act = 'out' AND sd.s = w.came THEN 'consolidating' END, c.act = 'out',
        CASE c.act WHEN 'late' THEN w.settled ELSE sd.i END,
        CASE c.act WHEN 'late' THEN w.settled + {most} WHEN 'zone' THEN least(sd.stop, w.settled + {most}) WHEN 'out' THEN sd.i + {conf - 1} WHEN 'back' THEN sd.stop ELSE sd.i END,
        'CONSOLIDATING', CASE WHEN c.act IN ('late', 'out') THEN 'FINISHED' END
      FROM walk w JOIN sd ON w.segment_id = sd.segment_id AND w.issue_id = sd.issue_id AND w.source = sd.source AND w.path_id = sd.path_id AND w.l = sd.l AND w.at_i = sd.i,
        LATERAL (SELECT CASE WHEN sd.i >= w.settled + {most} THEN 'late' WHEN sd.s = 0 THEN 'zone' WHEN w.settled + {most} < sd.n AND sd.i + {conf - 1} >= w.settled + {most} THEN 'wait'
          WHEN sd.i + {conf - 1} >= sd.n THEN 'open' WHEN sd.stop > sd.i + {conf - 1} THEN 'out' ELSE 'back' END AS act) c
      WHERE w.phase = 'hold'
    )
  ),
  wk AS (SELECT * FROM walk WHERE turn > 0),
  evx AS (SELECT {PATH}, kind AS event_type, level AS fib_level, entry AS entry_index, CASE WHEN came < 0 THEN 'below' ELSE 'above' END AS approach_side, CASE WHEN came < 0 THEN 'up' ELSE 'down' END AS approach_direction,
    CASE WHEN kind = 'HOVER' OR stage IS DISTINCT FROM 'approaching' THEN settled END AS hover_index, dwell AS dwell_time, kind <> 'HOVER' AS is_terminal, out_at AS output_index, stage AS pullback_stage,
    exit_at AS exit_index, CASE WHEN confirmed THEN out_at END AS confirmation_end_index, confirmed, l FROM wk WHERE kind IS NOT NULL),
  ex AS (SELECT e.*, sd.price AS exit_price, CASE WHEN e.confirmed THEN {STATES.format(s='sd.s')} END AS exit_direction FROM evx e LEFT JOIN sd ON e.segment_id = sd.segment_id AND e.issue_id = sd.issue_id AND e.source = sd.source AND e.path_id = sd.path_id AND e.l = sd.l AND e.exit_index = sd.i),
  ee AS (SELECT e.segment_id, e.issue_id, e.source, e.path_id, e.output_index, max(p.price) AS max_price_after, min(p.price) AS min_price_after FROM ex e JOIN ep p ON e.segment_id = p.segment_id AND e.issue_id = p.issue_id AND e.source = p.source AND e.path_id = p.path_id AND p.i BETWEEN e.exit_index AND e.output_index WHERE e.confirmed GROUP BY ALL),
  ev AS (SELECT {PATH}, event_type, fib_level, entry_index::INT AS entry_index, approach_side, approach_direction, hover_index::INT AS consolidation_index, hover_index::INT AS hover_index, dwell_time::INT AS dwell_time, is_terminal, output_index::INT AS output_index, pullback_stage,
    exit_direction, exit_index::INT AS exit_index, confirmation_end_index::INT AS confirmation_end_index, exit_price, max_price_after, min_price_after FROM ex LEFT JOIN ee USING ({PATH}, output_index)),
  marks AS (SELECT {PATH}, m_from AS a, m_to - 1 AS b, m_state AS state FROM wk WHERE m_to > m_from UNION ALL SELECT {PATH}, m_to, m_to, m_last FROM wk WHERE m_last IS NOT NULL),
  trace AS (SELECT p.segment_id, p.issue_id, p.source, p.path_id, p.step, p.i, coalesce(any_value(m.state), 'IDLE') AS state FROM ep p LEFT JOIN marks m ON p.segment_id = m.segment_id AND p.issue_id = m.issue_id AND p.source = m.source AND p.path_id = m.path_id AND p.i BETWEEN m.a AND m.b GROUP BY ALL)"""


#: Events that have a name, with the gates at the event and at its entry, over ``ev`` and ``traj``.
ALIGNED = f"""al AS (SELECT e.*, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items())} END AS event, CASE WHEN event_type = 'HOVER' THEN output_index ELSE exit_index END AS gate_index FROM ev e WHERE event_type <> 'TIMEOUT'),
  ag AS (SELECT al.*, gate_index - entry_index AS duration, h.p_bounce, h.p_break, h.p_hover, b.p_bounce AS p_bounce_entry, b.p_break AS p_break_entry, b.p_hover AS p_hover_entry,
    h.p_bounce - b.p_bounce AS p_bounce_change, h.p_break - b.p_break AS p_break_change, h.p_hover - b.p_hover AS p_hover_change
    FROM al JOIN traj h ON al.segment_id = h.segment_id AND al.issue_id = h.issue_id AND al.source = h.source AND al.path_id = h.path_id AND al.gate_index = h.step
    JOIN traj b ON al.segment_id = b.segment_id AND al.issue_id = b.issue_id AND al.source = b.source AND al.path_id = b.path_id AND al.entry_index = b.step)"""

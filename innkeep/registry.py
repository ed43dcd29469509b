"""Registered queries: name -> (Spark operator over T, DuckDB oracle SQL).

Every query reads the bound driver tables in full; parameters (dates,
hotel ids, filter values) are the report's inputs, not row caps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innkeep.plans import reports, search, status
from innkeep.plans import conflicts
from innkeep.plans.oracle import with_tables

AS_OF = "1998-06-15"
WIN_START, WIN_END = "1998-06-15", "1998-06-20"
HORIZON = 220
Q3 = dict(capacity="double", area="CITY_3", chain_id=3, min_category=3, max_price=950)
SEARCH = dict(capacity="double", min_category=3, min_total_rooms=30, max_price=1500,
              status="available", no_issues=True)

_REG: dict[str, tuple[Callable, str | None]] = {}
INTAKE_AS_OF = "2024-02-15"
LEAVING_SEGMENT = "HOUSEHOLD"  # customers of this segment are deleted (J6, J7, J19)
MIN_ROOMS = 100
POLICY_HOTEL = 3

# Helper CTEs (DuckDB) shared by several oracles; listed after the bindings.
HELPERS = {
    "cust_person": """SELECT c.customer_id, c.legal_id AS customer_legal_id,
        p.first_name || ' ' || p.last_name AS customer_full_name, p.first_name, p.last_name, c.hotel_id
        FROM customer_t c JOIN person p ON p.legal_id = c.legal_id""",
    "room_star": """SELECT r.room_id, r.room_number, r.hotel_id, h.hotel_name, hc.chain_name
        FROM room r JOIN hotel h ON h.hotel_id = r.hotel_id JOIN hotel_chain hc ON hc.chain_id = h.chain_id""",
    "leaving": f"SELECT c_custkey AS customer_id FROM customer WHERE c_mktsegment = '{LEAVING_SEGMENT}'",
}


def register(name: str, sql: str | None, extra: dict[str, str] | None = None):
    def deco(fn):
        _REG[name] = (fn, with_tables(sql, {**HELPERS, **(extra or {})}) if sql else None)
        return fn
    return deco


def registry() -> dict[str, tuple[Callable, str | None]]:
    return dict(_REG)


_OVL = "{a}.start_date < {b}.end_date AND {b}.start_date < {a}.end_date " \
       "AND {a}.start_date < {a}.end_date AND {b}.start_date < {b}.end_date"


def ovl(a, b):
    return _OVL.format(a=a, b=b)


def ovl_win(a, s=WIN_START, e=WIN_END):
    return (f"{a}.start_date < DATE '{e}' AND DATE '{s}' < {a}.end_date "
            f"AND {a}.start_date < {a}.end_date")


BLOCKS_SQL = f"""(SELECT room_id, start_date, end_date, 'booking' AS block_type, booking_id AS source_id
    FROM open_booking WHERE end_date > DATE '{AS_OF}'
  UNION ALL
  SELECT room_id, start_date, end_date, 'renting', renting_id
    FROM active_renting WHERE end_date > DATE '{AS_OF}')"""


# ---------------------------------------------------------------- reports
@register("k1_active_per_chain", """
SELECT c.chain_name, CAST(coalesce(sum(pr.n), 0) AS BIGINT) AS active_bookings
FROM room r JOIN hotel h USING (hotel_id) JOIN hotel_chain c USING (chain_id)
LEFT JOIN (SELECT room_id, count(*) AS n FROM open_booking GROUP BY room_id) pr USING (room_id)
GROUP BY c.chain_name""")
def q_k1(T):
    return reports.active_per_chain(T)


@register("areas_distinct", "SELECT DISTINCT area FROM hotel")
def q_areas(T):
    return reports.areas(T)


@register("rooms_per_area", """
SELECT h.area, CAST(count(*) AS INTEGER) AS available_rooms
FROM room r JOIN hotel h USING (hotel_id) WHERE r.current_status = 'available' GROUP BY h.area""")
def q_rooms_per_area(T):
    return reports.rooms_per_area(T)


_CAP_SQL = """SELECT h.hotel_id, h.hotel_name, h.address_line,
  CAST(sum(CASE r.capacity WHEN 'single' THEN 1 WHEN 'double' THEN 2 WHEN 'suite' THEN 3
                           WHEN 'family' THEN 4 ELSE 0 END) AS INTEGER) AS aggregated_capacity
FROM hotel h JOIN room r USING (hotel_id) GROUP BY h.hotel_id, h.hotel_name, h.address_line"""


@register("capacity_per_hotel", _CAP_SQL)
def q_capacity(T):
    return reports.capacity_per_hotel(T)


@register("capacity_top10", f"SELECT * FROM ({_CAP_SQL}) ORDER BY aggregated_capacity DESC, hotel_id LIMIT 10")
def q_capacity_top(T):
    return reports.capacity_top(T, 10)


@register("q3_available", f"""
SELECT r.room_id, h.hotel_name, c.chain_name, h.area, h.category, r.capacity, r.base_price
FROM room r JOIN hotel h USING (hotel_id) JOIN hotel_chain c USING (chain_id)
WHERE r.current_status = 'available' AND r.capacity = '{Q3['capacity']}' AND h.area = '{Q3['area']}'
  AND h.chain_id = {Q3['chain_id']} AND h.category >= {Q3['min_category']}
  AND r.base_price <= {Q3['max_price']}
  AND NOT EXISTS (SELECT 1 FROM open_booking b WHERE b.room_id = r.room_id AND {ovl_win('b')})
  AND NOT EXISTS (SELECT 1 FROM active_renting x WHERE x.room_id = r.room_id AND {ovl_win('x')})""")
def q_q3(T):
    return search.q3_available(T, start=WIN_START, end=WIN_END, **Q3)


@register("search_filters", f"""
SELECT r.room_id, r.room_number, r.hotel_id, h.hotel_name, h.chain_id, c.chain_name, h.area,
       h.category, r.capacity, r.base_price, r.current_status,
       coalesce(nullif(trim(r.issues, ' '), ''), 'None reported') AS issues_label
FROM room r JOIN hotel h USING (hotel_id) JOIN hotel_chain c USING (chain_id)
WHERE r.capacity = '{SEARCH['capacity']}' AND h.category >= {SEARCH['min_category']}
  AND h.total_rooms >= {SEARCH['min_total_rooms']} AND r.base_price <= {SEARCH['max_price']}
  AND r.current_status = '{SEARCH['status']}' AND nullif(trim(r.issues, ' '), '') IS NULL
  AND NOT EXISTS (SELECT 1 FROM open_booking b WHERE b.room_id = r.room_id AND {ovl_win('b')})
  AND NOT EXISTS (SELECT 1 FROM active_renting x WHERE x.room_id = r.room_id AND {ovl_win('x')})""")
def q_search(T):
    return search.search_rooms(T, start=WIN_START, end=WIN_END, **SEARCH)


@register("free_rooms_window", f"""
SELECT r.room_id, r.hotel_id FROM room r
WHERE NOT EXISTS (SELECT 1 FROM open_booking b WHERE b.room_id = r.room_id AND {ovl_win('b')})
  AND NOT EXISTS (SELECT 1 FROM active_renting x WHERE x.room_id = r.room_id AND {ovl_win('x')})""")
def q_free(T):
    return search.free_rooms(T, WIN_START, WIN_END).select("room_id", "hotel_id")


@register("unavailable_union", f"SELECT * FROM {BLOCKS_SQL}")
def q_union(T):
    return search.unavailable_union(T, AS_OF)


@register("unavailable_ranges", f"""
SELECT room_id, count(*) AS n_blocks, min(start_date) AS first_start, max(end_date) AS last_end
FROM {BLOCKS_SQL} GROUP BY room_id""")
def q_ranges(T):
    return search.unavailable_ranges(T, AS_OF)


@register("next_unavailable", f"""
SELECT room_id, start_date AS next_start, end_date AS next_end, block_type AS next_type,
       source_id AS next_source_id
FROM {BLOCKS_SQL}
QUALIFY row_number() OVER (PARTITION BY room_id ORDER BY start_date, end_date, block_type, source_id) = 1""")
def q_next(T):
    return search.next_unavailable(T, AS_OF)


@register("occupied_days", f"""
SELECT DISTINCT room_id, CAST(d AS DATE) AS day FROM (
  SELECT room_id, unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS d
  FROM (SELECT room_id, greatest(start_date, DATE '{AS_OF}') AS lo,
               least(end_date - 1, DATE '{AS_OF}' + {HORIZON}) AS hi FROM {BLOCKS_SQL})
  WHERE lo <= hi)""")
def q_days(T):
    return search.occupied_days(T, AS_OF, HORIZON)


@register("status_as_of", f"""
SELECT r.room_id, CASE
  WHEN r.current_status = 'maintenance' THEN 'maintenance'
  WHEN EXISTS (SELECT 1 FROM active_renting x WHERE x.room_id = r.room_id
               AND x.start_date <= DATE '{AS_OF}' AND DATE '{AS_OF}' < x.end_date) THEN 'rented'
  WHEN EXISTS (SELECT 1 FROM open_booking b WHERE b.room_id = r.room_id
               AND b.start_date <= DATE '{AS_OF}' AND DATE '{AS_OF}' < b.end_date) THEN 'booked'
  ELSE 'available' END AS status
FROM room r""")
def q_status(T):
    return status.status_as_of(T, AS_OF)


@register("employees_at_hotel", """
SELECT e.employee_id, e.legal_id, p.first_name, p.last_name, e.hotel_id, e.role_title,
       e.hired_on, e.is_manager
FROM employee e JOIN person p USING (legal_id) WHERE e.hotel_id = 3""")
def q_emp(T):
    return reports.employees_at_hotel(T, 3)


@register("managers_register", """
SELECT e.employee_id AS manager_employee_id, e.legal_id AS manager_sin, p.first_name, p.last_name,
       p.email, p.phone, h.hotel_id, h.hotel_name, c.chain_id, c.chain_name, e.role_title,
       e.hired_on, a.username AS account_username, a.is_active AS account_is_active
FROM employee e JOIN person p USING (legal_id) JOIN hotel h USING (hotel_id)
JOIN hotel_chain c ON c.chain_id = h.chain_id
LEFT JOIN (SELECT * FROM auth_account WHERE role = 'manager') a ON a.employee_id = e.employee_id
WHERE e.is_manager""")
def q_managers(T):
    return reports.managers_register(T)


# ---------------------------------------------------------------- conflicts
@register("room_conflict_pairs", f"""
SELECT a.room_id, a.booking_id AS booking_id_a, b.booking_id AS booking_id_b
FROM open_booking a JOIN open_booking b
  ON a.room_id = b.room_id AND a.booking_id < b.booking_id AND {ovl('a', 'b')}""")
def q_room_pairs(T):
    return conflicts.booking_pairs(T, "room_id")


@register("customer_conflict_pairs", f"""
SELECT a.customer_id, a.booking_id AS booking_id_a, b.booking_id AS booking_id_b
FROM open_booking a JOIN open_booking b
  ON a.customer_id = b.customer_id AND a.booking_id < b.booking_id AND {ovl('a', 'b')}""")
def q_cust_pairs(T):
    return conflicts.booking_pairs(T, "customer_id")


@register("booking_renting_pairs", f"""
SELECT b.room_id, b.booking_id, x.renting_id
FROM open_booking b JOIN active_renting x ON b.room_id = x.room_id AND {ovl('b', 'x')}""")
def q_br_pairs(T):
    return conflicts.booking_renting_pairs(T)


@register("conflict_flags", f"""
SELECT b.booking_id,
  EXISTS (SELECT 1 FROM active_renting x WHERE x.room_id = b.room_id AND {ovl('b', 'x')}) AS has_renting_clash,
  EXISTS (SELECT 1 FROM open_booking o WHERE o.room_id = b.room_id AND o.booking_id <> b.booking_id
          AND {ovl('b', 'o')}) AS has_booking_clash
FROM open_booking b""")
def q_flags(T):
    return conflicts.conflict_flags(T)


def _rule_sql():
    parts = []
    for side, me, idc, excl in (("booking", "open_booking", "booking_id", None),
                                ("renting", "active_renting", "renting_id", "source_booking_id")):
        for key in ("room_id", "customer_id"):
            for other, tab, oid in (("booking", "open_booking", "booking_id"),
                                    ("renting", "active_renting", "renting_id")):
                cond = f"o.{key} = n.{key} AND {ovl('n', 'o')}"
                if other == side:
                    cond += f" AND o.{oid} <> n.{idc}"
                elif excl and other == "booking":
                    cond += " AND (n.source_booking_id IS NULL OR o.booking_id <> n.source_booking_id)"
                rule = f"{key.split('_')[0]}_{other}"
                parts.append(f"SELECT '{side}' AS record_type, n.{idc} AS record_id, '{rule}' AS rule "
                             f"FROM {me} n WHERE EXISTS (SELECT 1 FROM {tab} o WHERE {cond})")
    return "\nUNION ALL\n".join(parts)


@register("conflict_rules", _rule_sql())
def q_rules(T):
    return conflicts.find_conflicts(T)


# ---------------------------------------------------------------- archive
from innkeep.plans import archive as arch  # noqa: E402
from innkeep.plans import repair, tables, transitions  # noqa: E402
from innkeep.operators.rank import global_rank  # noqa: E402
from innkeep.sources.bindings import _lpad_id, booking_requests, transition_requests  # noqa: E402


def snap_sql(kind: str, src: str, where: str = "TRUE") -> str:
    ids = ("s.booking_id, CAST(NULL AS BIGINT)" if kind == "booking"
           else "s.source_booking_id, s.renting_id")
    return (f"SELECT '{kind}' AS record_type, {ids.split(', ')[0]} AS source_booking_id, "
            f"{ids.split(', ')[1]} AS source_renting_id, rs.chain_name, rs.hotel_name, rs.room_number, "
            f"cp.customer_full_name, cp.customer_legal_id, s.start_date, s.end_date, s.status AS final_status "
            f"FROM {src} s JOIN room_star rs ON rs.room_id = s.room_id "
            f"JOIN cust_person cp ON cp.customer_id = s.customer_id WHERE {where}")


ARCHIVE_BF = (snap_sql("booking", "booking", "s.status IN ('completed', 'cancelled')") + "\nUNION ALL\n"
              + snap_sql("renting", "renting", "s.status IN ('completed', 'cancelled')"))
HELPERS["archive_bf"] = ARCHIVE_BF


def _leaving(T):
    return T["_raw"]["customer"].filter(F.col("c_mktsegment") == LEAVING_SEGMENT) \
        .select(F.col("c_custkey").alias("customer_id"))


@register("archive_backfill", "SELECT * FROM archive_bf")
def q_archive_backfill(T):
    return arch.archive_backfill(T)


TRANS_CTES = {
    "trans_req": """SELECT event_id AS request_id, event_id - event_id % 4 AS booking_id, ts AS arrival,
        CASE event_type WHEN 'click' THEN 'check_in' WHEN 'view' THEN 'cancel'
             WHEN 'purchase' THEN 'complete' WHEN 'signup' THEN 'redate' ELSE 'invalid' END AS action,
        CASE WHEN user_id % 10 = 0 THEN 'admin' WHEN user_id % 2 = 0 THEN 'staff' ELSE 'customer' END AS actor,
        CASE WHEN user_id % 10 <> 0 AND user_id % 2 = 0 THEN user_id END AS actor_employee_id,
        CASE WHEN user_id % 2 = 1 THEN CASE WHEN user_id % 4 = 1 THEN user_id ELSE o.o_custkey END END AS actor_customer_id,
        CASE WHEN event_type = 'signup' THEN CAST(ts AS DATE) + coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0) END AS new_start,
        CASE WHEN event_type = 'signup' THEN CAST(ts AS DATE) + coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0)
             + CAST(1 + event_id % 5 AS INTEGER) END AS new_end
        FROM events LEFT JOIN orders o ON o.o_orderkey = events.event_id - events.event_id % 4""",
    # checks that don't depend on the booking's state, and the turn of each request
    "trans_seq": f"""SELECT q.*, b.room_id, b.customer_id,
        row_number() OVER (PARTITION BY q.booking_id ORDER BY q.arrival, q.request_id) AS n,
        CASE WHEN q.actor = 'customer' AND q.action NOT IN ('cancel', 'invalid') THEN 'staff_only'
          WHEN q.action = 'invalid' THEN 'unknown_action'
          WHEN q.action = 'redate' AND (q.new_start IS NULL OR q.new_end IS NULL) THEN 'no_date'
          WHEN q.action = 'redate' AND q.new_start < DATE '{AS_OF}' THEN 'start_in_past'
          WHEN q.action = 'redate' AND q.new_end <= q.new_start THEN 'bad_range'
          WHEN b.room_id IS NULL THEN 'no_such_booking'
          WHEN q.actor = 'customer' AND b.customer_id <> q.actor_customer_id THEN 'no_such_booking'
          WHEN q.actor = 'staff' AND (e.hotel_id IS NULL OR e.hotel_id <> r.hotel_id) THEN 'other_hotel' END AS fixed
        FROM trans_req q LEFT JOIN booking b ON b.booking_id = q.booking_id
        LEFT JOIN room r ON r.room_id = b.room_id
        LEFT JOIN employee e ON e.employee_id = q.actor_employee_id""",
    "trans_clash": """SELECT t.request_id, CASE
          WHEN EXISTS (SELECT 1 FROM open_booking o WHERE o.room_id = t.room_id AND o.booking_id <> t.booking_id
               AND o.start_date < t.new_end AND t.new_start < o.end_date AND o.start_date < o.end_date AND t.new_start < t.new_end) THEN 'room_booking'
          WHEN EXISTS (SELECT 1 FROM active_renting o WHERE o.room_id = t.room_id
               AND o.start_date < t.new_end AND t.new_start < o.end_date AND o.start_date < o.end_date AND t.new_start < t.new_end) THEN 'room_renting'
          WHEN EXISTS (SELECT 1 FROM open_booking o WHERE o.customer_id = t.customer_id AND o.booking_id <> t.booking_id
               AND o.start_date < t.new_end AND t.new_start < o.end_date AND o.start_date < o.end_date AND t.new_start < t.new_end) THEN 'customer_booking'
          WHEN EXISTS (SELECT 1 FROM active_renting o WHERE o.customer_id = t.customer_id
               AND o.start_date < t.new_end AND t.new_start < o.end_date AND o.start_date < o.end_date AND t.new_start < t.new_end) THEN 'customer_renting'
          END AS clash
        FROM trans_seq t WHERE t.action = 'redate' AND t.fixed IS NULL""",
    # the row lock's order: every booking meets its requests one after another
    "trans_state": f"""SELECT booking_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS VARCHAR) AS reason,
          status AS old_status, start_date AS old_start_date, end_date AS old_end_date, status, start_date, end_date FROM booking
        UNION ALL
        SELECT booking_id, n, request_id, reason, old_status, old_start_date, old_end_date,
          CASE WHEN reason IS NOT NULL THEN old_status WHEN action = 'check_in' THEN 'checked_in'
               WHEN action = 'cancel' THEN 'cancelled' WHEN action = 'complete' THEN 'completed' ELSE old_status END,
          CASE WHEN reason IS NULL AND action = 'redate' THEN new_start ELSE old_start_date END,
          CASE WHEN reason IS NULL AND action = 'redate' THEN new_end ELSE old_end_date END
        FROM (SELECT s.booking_id, q.n, q.request_id, q.action, q.new_start, q.new_end,
                s.status AS old_status, s.start_date AS old_start_date, s.end_date AS old_end_date,
                CASE WHEN q.fixed IS NOT NULL THEN q.fixed
                  WHEN q.action = 'redate' THEN CASE WHEN s.status <> 'reserved' THEN 'not_reserved' ELSE c.clash END
                  WHEN q.action = 'cancel' THEN CASE
                    WHEN q.actor = 'customer' AND s.status <> 'reserved' THEN 'not_cancellable'
                    WHEN s.status NOT IN ('reserved', 'checked_in') THEN 'not_cancellable'
                    WHEN s.end_date < DATE '{AS_OF}' THEN 'already_ended' END
                  WHEN q.action = 'check_in' THEN CASE WHEN s.status <> 'reserved' THEN 'not_reserved'
                    WHEN s.start_date <> DATE '{AS_OF}' THEN 'not_arrival_day' END
                  WHEN q.action = 'complete' THEN CASE WHEN s.status NOT IN ('reserved', 'checked_in') THEN 'not_open'
                    WHEN s.end_date >= DATE '{AS_OF}' THEN 'not_ended' END END AS reason
              FROM trans_state s JOIN trans_seq q ON q.booking_id = s.booking_id AND q.n = s.n + 1
              LEFT JOIN trans_clash c ON c.request_id = q.request_id) step""",
    "trans_out": """SELECT q.request_id, q.booking_id, q.action, coalesce(s.reason, CASE WHEN s.request_id IS NULL THEN q.fixed END) IS NULL AS accepted,
        coalesce(s.reason, CASE WHEN s.request_id IS NULL THEN q.fixed END) AS reason, s.old_status, s.old_start_date, s.old_end_date,
        s.status AS new_status, s.start_date AS new_start_date, s.end_date AS new_end_date
        FROM trans_seq q LEFT JOIN trans_state s ON s.request_id = q.request_id""",
}


def _decided(T):
    return transitions.apply_transitions(
        T, transition_requests(T["_raw"]["events"], T["_raw"]["orders"]), AS_OF)


@register("transitions", "SELECT * FROM trans_out", TRANS_CTES)
def q_transitions(T):
    return _decided(T).drop("arrival")


@register("transitions_in_order", None)
def q_transitions_in_order(T):
    """J15 with the batch's re-dates meeting each other; tests replay it over all bookings."""
    from innkeep.plans.reorder import apply_in_order
    T = _stays_once(T)
    return apply_in_order(T, transition_requests(T["_raw"]["events"], T["_raw"]["orders"]), AS_OF)


@register("archive_transitions", snap_sql(
    "booking", "(SELECT b.booking_id, b.room_id, b.customer_id, o.new_start_date AS start_date, "
    "o.new_end_date AS end_date, o.new_status AS status, o.old_status FROM trans_out o "
    "JOIN booking b ON b.booking_id = o.booking_id WHERE o.accepted)",
    "s.status IN ('completed', 'cancelled') AND s.status IS DISTINCT FROM s.old_status "
    "AND s.booking_id NOT IN (SELECT source_booking_id FROM archive_bf WHERE record_type = 'booking')"),
    TRANS_CTES)
def q_archive_transitions(T):
    changes = transitions.transition_changes(T, _decided(T))
    return arch.archive_transitions(T, changes, arch.archive_backfill(T))


def _stays_once(T) -> dict:
    """``T`` with bookings and rentings written once: a query that asks them several times would group
    all lineitems anew each time."""
    base = streams.scratch_dir(T["booking"].sparkSession, "stays")
    for name in ("booking", "renting"):
        T[name].write.parquet(f"{base}/{name}")
    return {**T, **{n: T[n].sparkSession.read.schema(T[n].schema).parquet(f"{base}/{n}") for n in ("booking", "renting")}}


_HIST_SQL = (snap_sql("booking", "booking", "s.customer_id IN (SELECT customer_id FROM leaving) AND NOT EXISTS "
                      "(SELECT 1 FROM archive_bf a WHERE a.record_type = 'booking' AND a.source_booking_id = s.booking_id)")
             + "\nUNION ALL\n"
             + snap_sql("renting", "renting", "s.customer_id IN (SELECT customer_id FROM leaving) AND NOT EXISTS "
                        "(SELECT 1 FROM archive_bf a WHERE a.record_type = 'renting' AND a.source_renting_id = s.renting_id)"))


@register("customer_history", _HIST_SQL)
def q_customer_history(T):
    return arch.customer_history(T, _leaving(T), arch.archive_backfill(T))


@register("orphan_refs", """
SELECT a.record_type,
  CASE WHEN a.source_booking_id IN (SELECT booking_id FROM booking WHERE customer_id NOT IN (SELECT customer_id FROM leaving))
       THEN a.source_booking_id END AS source_booking_id,
  CASE WHEN a.record_type <> 'booking' AND a.source_renting_id IN
       (SELECT renting_id FROM renting WHERE customer_id NOT IN (SELECT customer_id FROM leaving))
       THEN a.source_renting_id END AS source_renting_id,
  a.chain_name, a.hotel_name, a.room_number, a.customer_full_name, a.customer_legal_id,
  a.start_date, a.end_date, a.final_status
FROM (SELECT * FROM archive_bf UNION ALL SELECT * FROM hist) a""", {"hist": _HIST_SQL})
def q_orphan_refs(T):
    T = _stays_once(T)
    archive = arch.archive_backfill(T)
    archive = archive.unionByName(arch.customer_history(T, _leaving(T), archive))
    gone = _leaving(T)
    return arch.null_orphan_refs(archive, T["booking"].join(gone, "customer_id", "left_anti"),
                                 T["renting"].join(gone, "customer_id", "left_anti"))


@register("delete_cascade", """
SELECT 'customer' AS table_name, 'delete' AS action, count(*) AS n_rows FROM customer_t
  WHERE customer_id IN (SELECT customer_id FROM leaving)
UNION ALL SELECT 'auth_account', 'delete', count(*) FROM auth_account WHERE customer_id IN (SELECT customer_id FROM leaving)
UNION ALL SELECT 'booking', 'delete', count(*) FROM booking WHERE customer_id IN (SELECT customer_id FROM leaving)
UNION ALL SELECT 'renting', 'delete', count(*) FROM renting WHERE customer_id IN (SELECT customer_id FROM leaving)
UNION ALL SELECT 'payment', 'delete', count(*) FROM payment WHERE renting_id IN
  (SELECT renting_id FROM renting WHERE customer_id IN (SELECT customer_id FROM leaving))
UNION ALL SELECT 'renting.source_booking_id', 'set_null', count(*) FROM renting
  WHERE source_booking_id IN (SELECT booking_id FROM booking WHERE customer_id IN (SELECT customer_id FROM leaving))
    AND customer_id NOT IN (SELECT customer_id FROM leaving)""")
def q_delete(T):
    deleted, nulled = tables.delete_cascade(T, "customer", _leaving(T))
    return tables.delete_summary(deleted, nulled)


#: Tables of the cascade, their keys, and the columns shown after it.
_AFTER = {"customer": (["customer_id"], "hotel_id"), "auth_account": (["account_id"], "customer_id"), "booking": (["booking_id"], "created_by_employee_id"),
          "renting": (["renting_id"], "source_booking_id"), "archive": (["archive_id"], "source_renting_id")}
_GONE = "(SELECT customer_id FROM leaving)"


def _with_archive(T) -> dict:
    """The tables with an archive of finished stays (archive_id from the stay's own id)."""
    a = arch.archive_backfill(T)
    ident = F.when(F.col("record_type") == "booking", F.col("source_booking_id") * 2).otherwise(F.col("source_renting_id") * 2 + 1)
    return {**T, "archive": a.withColumn("archive_id", ident)}


@register("cascade_tables_after", f"""
SELECT 'customer' AS table_name, customer_id AS id, CAST(hotel_id AS BIGINT) AS reference FROM customer_t WHERE customer_id NOT IN {_GONE}
UNION ALL SELECT 'auth_account', account_id, customer_id FROM auth_account WHERE customer_id IS NULL OR customer_id NOT IN {_GONE}
UNION ALL SELECT 'booking', booking_id, created_by_employee_id FROM booking WHERE customer_id NOT IN {_GONE}
UNION ALL SELECT 'renting', renting_id, CASE WHEN source_booking_id NOT IN (SELECT booking_id FROM booking WHERE customer_id IN {_GONE}) THEN source_booking_id END
  FROM renting WHERE customer_id NOT IN {_GONE}
UNION ALL SELECT 'archive', CASE WHEN record_type = 'booking' THEN source_booking_id * 2 ELSE source_renting_id * 2 + 1 END,
  CASE WHEN source_renting_id NOT IN (SELECT renting_id FROM renting WHERE customer_id IN {_GONE}) THEN source_renting_id END FROM archive_bf""")
def q_cascade_after(T):
    """The cascade published as one version of all tables it reaches, and read back."""
    from innkeep.sources.versions import VersionedTables
    spark = T["booking"].sparkSession
    store = VersionedTables(spark, streams.scratch_dir(spark, "versions"))
    T = _with_archive(_stays_once({n: df for n, df in T.items() if n != "payment"}))
    store.publish({n: (T[n], key) for n, (key, _ref) in _AFTER.items()})
    kept = {**T, **{n: store.read(n) for n in _AFTER}}
    store.apply(tables.cascade_changes(kept, "customer", _leaving(T)))
    parts = [store.read(n).select(F.lit(n).alias("table_name"), F.col(key[0]).alias("id"), F.col(ref).cast("bigint").alias("reference"))
             for n, (key, ref) in _AFTER.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- reports (more)
@register("stay_history", """
SELECT b.booking_id, b.customer_id, b.room_id, b.start_date, b.end_date, b.status,
       x.renting_id AS linked_renting_id, coalesce(x.status, 'Not checked in yet') AS renting_label
FROM booking b LEFT JOIN renting x ON x.source_booking_id = b.booking_id""")
def q_stay_history(T):
    return reports.stay_history(T)


@register("open_bookings_board", f"""
SELECT booking_id, room_id, customer_id, start_date, end_date, status,
  end_date < DATE '{AS_OF}' AS is_overdue,
  status = 'reserved' AND start_date = DATE '{AS_OF}' AS can_check_in,
  status IN ('reserved', 'checked_in') AND end_date >= DATE '{AS_OF}' AS can_cancel,
  status = 'reserved' AND end_date >= DATE '{AS_OF}' AS can_update_dates,
  end_date < DATE '{AS_OF}' AS can_complete,
  regexp_replace(lower(status), '[^a-z_]', '_', 'g') AS status_slug
FROM open_booking""")
def q_board(T):
    return reports.open_bookings_board(T, AS_OF)


@register("payments_board", """
SELECT p.renting_id, p.employee_id, p.amount, CASE WHEN p.method = 'credit' THEN 'card' ELSE p.method END AS method_label,
       p.paid_at, strftime(p.paid_at, '%Y-%m-%d %H:%M') AS paid_at_text, x.room_id, r.hotel_id, r.room_number, x.customer_id, cp.customer_full_name
FROM payment p JOIN renting x ON x.renting_id = p.renting_id JOIN room r ON r.room_id = x.room_id
JOIN cust_person cp ON cp.customer_id = x.customer_id""")
def q_payments(T):
    return reports.payments_board(T)


@register("staff_counts", """
SELECT h.hotel_id, CAST(coalesce(e.m, 0) AS BIGINT) AS managers, CAST(coalesce(e.n, 0) AS BIGINT) AS employees,
       CAST(coalesce(r.c, 0) AS BIGINT) AS rooms
FROM hotel h
LEFT JOIN (SELECT hotel_id, count(*) FILTER (WHERE is_manager) AS m, count(*) FILTER (WHERE NOT is_manager) AS n
           FROM employee GROUP BY hotel_id) e ON e.hotel_id = h.hotel_id
LEFT JOIN (SELECT hotel_id, count(*) AS c FROM room GROUP BY hotel_id) r ON r.hotel_id = h.hotel_id""")
def q_staff_counts(T):
    return reports.staff_counts(T)


@register("customer_hotel_attribution", """
SELECT c.customer_id, coalesce(bh.h, rh.h) AS hotel_id
FROM customer_t c
LEFT JOIN (SELECT b.customer_id, min(r.hotel_id) AS h FROM booking b JOIN room r ON r.room_id = b.room_id GROUP BY 1) bh
  ON bh.customer_id = c.customer_id
LEFT JOIN (SELECT x.customer_id, min(r.hotel_id) AS h FROM renting x JOIN room r ON r.room_id = x.room_id GROUP BY 1) rh
  ON rh.customer_id = c.customer_id
WHERE c.hotel_id IS NULL""")
def q_attr(T):
    return repair.attribute_customer_hotel(T)


_SPEND = """SELECT x.customer_id, CAST(sum(p.amount) AS DECIMAL(20,2)) AS total_spent
  FROM payment p JOIN renting x ON x.renting_id = p.renting_id GROUP BY x.customer_id"""


@register("spend_above_average", """
SELECT customer_id, total_spent FROM spend
WHERE total_spent > (SELECT CAST(avg(total_spent) AS DECIMAL(20,6)) FROM spend)""", {"spend": _SPEND})
def q_spend(T):
    return reports.spend_above_average(T)


@register("employee_performance", """
SELECT e.employee_id, e.hotel_id, CAST(coalesce(b.n, 0) AS BIGINT) AS bookings_created,
  CAST(coalesce(x.n, 0) AS BIGINT) AS rentings_handled, CAST(coalesce(p.n, 0) AS BIGINT) AS payments_taken,
  CAST(coalesce(p.s, 0) AS DECIMAL(20,2)) AS amount_taken
FROM employee e
LEFT JOIN (SELECT created_by_employee_id AS employee_id, count(*) AS n FROM booking GROUP BY 1) b ON b.employee_id = e.employee_id
LEFT JOIN (SELECT employee_id, count(*) AS n FROM renting GROUP BY 1) x ON x.employee_id = e.employee_id
LEFT JOIN (SELECT employee_id, count(*) AS n, sum(amount) AS s FROM payment GROUP BY 1) p ON p.employee_id = e.employee_id""")
def q_perf(T):
    return reports.employee_performance(T)


@register("missing_accounts", """
SELECT CASE WHEN e.is_manager THEN 'manager' ELSE 'employee' END AS role,
  CASE WHEN e.is_manager THEN 'manager' ELSE 'employee' END || CAST(e.employee_id AS VARCHAR) AS username,
  e.employee_id, CAST(NULL AS BIGINT) AS customer_id, true AS is_active
FROM employee e WHERE NOT EXISTS (SELECT 1 FROM auth_account a WHERE a.employee_id = e.employee_id)
UNION ALL
SELECT 'customer', 'customer' || CAST(c.customer_id AS VARCHAR), CAST(NULL AS BIGINT), c.customer_id, true
FROM customer_t c WHERE NOT EXISTS (SELECT 1 FROM auth_account a WHERE a.customer_id = c.customer_id)
UNION ALL
SELECT 'admin', 'admin', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), true
WHERE NOT EXISTS (SELECT 1 FROM auth_account WHERE role = 'admin')""")
def q_missing_accounts(T):
    return repair.missing_accounts(T)


@register("open_stay_flags", """
SELECT c.customer_id,
  EXISTS (SELECT 1 FROM open_booking b WHERE b.customer_id = c.customer_id) AS has_open_booking,
  EXISTS (SELECT 1 FROM active_renting x WHERE x.customer_id = c.customer_id) AS has_active_renting
FROM customer_t c""")
def q_open_flags(T):
    return reports.open_stay_flags(T)


@register("masked_register", f"""
SELECT cp.customer_id, cp.customer_legal_id AS legal_id, cp.first_name, cp.last_name, cp.hotel_id,
  coalesce(h.hotel_name, 'Unassigned') AS hotel_label, a.username, a.is_active,
  CAST(NULL AS VARCHAR) AS password_plain
FROM cust_person cp LEFT JOIN hotel h ON h.hotel_id = cp.hotel_id
LEFT JOIN (SELECT * FROM auth_account WHERE role = 'customer') a ON a.customer_id = cp.customer_id
WHERE cp.hotel_id = {POLICY_HOTEL} OR cp.hotel_id IS NULL""")
def q_masked(T):
    return reports.customer_register(T, "employee", POLICY_HOTEL)


@register("row_policy", f"""
SELECT * FROM open_booking WHERE room_id IN (SELECT room_id FROM room WHERE hotel_id = {POLICY_HOTEL})""")
def q_policy(T):
    from innkeep.plans.common import open_bookings
    return reports.row_policy(open_bookings(T), T, POLICY_HOTEL)


# ---------------------------------------------------------------- ranks and repair
@register("global_rank", "SELECT renting_id, row_number() OVER (ORDER BY renting_id) AS rn FROM renting")
def q_global_rank(T):
    return global_rank(T["renting"].select("renting_id"), ["renting_id"], "rn")


@register("every_fifth", """
SELECT room_id, rn, CASE rn % 4 WHEN 0 THEN 'Minor paint damage near balcony door'
  WHEN 1 THEN 'AC filter noise at high fan speed' WHEN 2 THEN 'Bathroom sink drains slowly'
  ELSE 'Desk lamp flickers intermittently' END AS issues
FROM (SELECT room_id, row_number() OVER (ORDER BY room_id) AS rn FROM room
      WHERE nullif(trim(issues, ' '), '') IS NULL) WHERE rn % 5 = 0""")
def q_every_fifth(T):
    return repair.populate_issues(T["room"])


@register("duplicate_rank", """
SELECT legal_id, email, row_number() OVER (PARTITION BY legal_id ORDER BY email) AS duplicate_rank
FROM person_raw""")
def q_dup_rank(T):
    return repair.duplicate_rank(T["person_raw"]).select("legal_id", "email", "duplicate_rank")


@register("repair_keys", """
SELECT legal_id, legal_id AS old_legal_id, 'SIN' AS id_type, first_name, last_name, email, false AS key_overflow
FROM pr WHERE regexp_matches(legal_id, '^[0-9]{9}$') AND dr = 1
UNION ALL
SELECT CASE WHEN m.m + f.rk <= 999999999 THEN lpad(CAST(m.m + f.rk AS VARCHAR), 9, '0') END, f.legal_id, 'SIN', f.first_name, f.last_name, f.email,
       m.m + f.rk > 999999999
FROM (SELECT *, row_number() OVER (ORDER BY legal_id, email) AS rk FROM pr
      WHERE NOT regexp_matches(legal_id, '^[0-9]{9}$') OR dr > 1) f,
     (SELECT coalesce(max(CAST(legal_id AS BIGINT)), 100000000) AS m FROM person_raw
      WHERE regexp_matches(legal_id, '^[0-9]{9}$')) m""",
    {"pr": "SELECT *, row_number() OVER (PARTITION BY legal_id ORDER BY email) AS dr FROM person_raw"})
def q_repair_keys(T):
    return repair.repair_keys(T["person_raw"]).select(
        "legal_id", "old_legal_id", "id_type", "first_name", "last_name", "email", "key_overflow")


@register("legacy_coalesce", """
SELECT room_id, coalesce(hotel_id, hotel_room_id) AS hotel_id, coalesce(capacity, room_capacity) AS capacity,
  coalesce(base_price, price) AS base_price, coalesce(current_status, status) AS current_status,
  coalesce(is_extendable, extendable) AS is_extendable, coalesce(issues, problems) AS issues,
  CASE WHEN v IS NOT NULL THEN v IN ('sea', 'sea_mountain') ELSE has_sea_view END AS has_sea_view,
  CASE WHEN v IS NOT NULL THEN v IN ('mountain', 'sea_mountain') ELSE has_mountain_view END AS has_mountain_view
FROM (SELECT p_partkey AS room_id,
        CASE WHEN p_size % 10 <> 0 THEN p_partkey % 25 END AS hotel_id, p_partkey % 25 AS hotel_room_id,
        CASE WHEN p_size % 7 <> 0 THEN c END AS capacity, c AS room_capacity,
        CASE WHEN p_size % 8 <> 0 THEN CAST(p_retailprice AS DECIMAL(10,2)) END AS base_price,
        CAST(p_retailprice AS DECIMAL(10,2)) AS price,
        CASE WHEN p_size % 6 <> 0 THEN 'available' END AS current_status,
        CASE WHEN p_size = 13 THEN 'maintenance' ELSE 'available' END AS status,
        CASE WHEN p_size % 5 <> 0 THEN p_partkey % 2 = 0 END AS is_extendable, p_size % 2 = 0 AS extendable,
        CAST(NULL AS VARCHAR) AS issues, CASE WHEN p_size % 9 = 0 THEN p_name END AS problems,
        p_size % 4 = 0 AS has_sea_view, p_size % 3 = 0 AS has_mountain_view,
        CASE WHEN p_size % 11 = 0 THEN 'sea' WHEN p_size % 11 = 1 THEN 'sea_mountain'
             WHEN p_size % 11 = 2 THEN 'mountain' END AS v
      FROM (SELECT *, CASE p_size % 4 WHEN 0 THEN 'single' WHEN 1 THEN 'double' WHEN 2 THEN 'suite'
                      ELSE 'family' END AS c FROM part))""")
def q_legacy(T):
    return repair.coalesce_legacy_columns(repair.legacy_rooms(T["_raw"]["part"])).select(
        "room_id", "hotel_id", "capacity", "base_price", "current_status", "is_extendable", "issues",
        "has_sea_view", "has_mountain_view")


@register("fill_room_numbers", f"""
SELECT hotel_id, CAST(num AS VARCHAR) AS room_number, used + k - 1 AS slot,
  CASE (used + k - 1) % 5 WHEN 0 THEN 'single' WHEN 1 THEN 'double' WHEN 2 THEN 'suite'
       WHEN 3 THEN 'family' ELSE 'double' END AS capacity,
  CAST(95 + hotel_id * 2 + (used + k - 1) * 12 AS DECIMAL(10,2)) AS base_price,
  false AS has_sea_view, false AS has_mountain_view, (used + k - 1) % 5 IN (1, 3, 4) AS is_extendable,
  'WiFi, TV' AS amenities, CAST(NULL AS VARCHAR) AS issues, 'available' AS current_status
FROM (SELECT c.*, row_number() OVER (PARTITION BY hotel_id ORDER BY num) AS k
      FROM (SELECT hotel_id, used, need, unnest(range(100, 100 + used + need)) AS num
            FROM (SELECT h.hotel_id, coalesce(u.n, 0) AS used, {MIN_ROOMS} - coalesce(u.n, 0) AS need
                  FROM hotel h LEFT JOIN (SELECT hotel_id, count(*) AS n FROM room GROUP BY 1) u
                  ON u.hotel_id = h.hotel_id) WHERE need > 0) c
      WHERE NOT EXISTS (SELECT 1 FROM room r WHERE r.hotel_id = c.hotel_id AND r.room_number = CAST(c.num AS VARCHAR)))
WHERE k <= need""")
def q_fill_rooms(T):
    return repair.fill_rooms(T, MIN_ROOMS)


@register("fill_staff", f"""
SELECT mx.m + z.rk AS employee_id, z.hotel_id, z.is_manager,
  CASE WHEN z.is_manager THEN 'Manager' ELSE 'Guest Services Agent' END AS role_title,
  CASE WHEN ms.s + z.rk <= 999999999 THEN lpad(CAST(ms.s + z.rk AS VARCHAR), 9, '0') END AS legal_id,
  CASE WHEN z.is_manager THEN 'Hotel' ELSE 'Frontdesk' END AS first_name,
  CASE WHEN z.is_manager THEN 'Manager' ELSE 'Employee' END || CAST(z.hotel_id AS VARCHAR) AS last_name,
  CASE WHEN z.is_manager THEN 'manager' ELSE 'employee' END || '.hotel' || CAST(z.hotel_id AS VARCHAR) || '.'
    || CASE WHEN ms.s + z.rk <= 999999999 THEN lpad(CAST(ms.s + z.rk AS VARCHAR), 9, '0') END || '@workmail.com' AS email,
  right(CAST(2000000000 + (ms.s + z.rk) % 7000000000 AS VARCHAR), 10) AS phone,
  CAST(z.hotel_id + 300 AS VARCHAR) || ' Service Road' AS address_line,
  DATE '{AS_OF}' AS hired_on
FROM (SELECT n.*, row_number() OVER (ORDER BY n.hotel_id, CASE WHEN n.is_manager THEN 0 ELSE 1 END) AS rk
      FROM (SELECT h.hotel_id, true AS is_manager FROM hotel h
            WHERE NOT EXISTS (SELECT 1 FROM employee e WHERE e.hotel_id = h.hotel_id AND e.is_manager)
            UNION ALL
            SELECT h.hotel_id, false FROM hotel h
            WHERE NOT EXISTS (SELECT 1 FROM employee e WHERE e.hotel_id = h.hotel_id AND NOT e.is_manager)) n) z,
     (SELECT coalesce(max(employee_id), 0) AS m FROM employee) mx,
     (SELECT coalesce(max(CAST(legal_id AS BIGINT)), 100000000) AS s FROM person
      WHERE regexp_matches(legal_id, '^[0-9]{{9}}$')) ms""")
def q_fill_staff(T):
    return repair.fill_staff(T, AS_OF)


# ---------------------------------------------------------------- intake and lifecycle
BOOKING_REQ = {
    "booking_req": """SELECT event_id AS request_id, ts AS arrival, user_id AS customer_id,
        (event_id * 7919) % (SELECT count(*) // 4 FROM part) AS room_id,
        CAST(ts AS DATE) + coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS start_date,
        CAST(ts AS DATE) + coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0)
          + CAST(1 + event_id % 5 AS INTEGER) AS end_date
        FROM events WHERE event_type <> 'error'""",
    "intake": f"""SELECT q.*, r.hotel_id,
        CASE WHEN q.start_date < DATE '{INTAKE_AS_OF}' THEN 'start_in_past'
             WHEN q.end_date <= q.start_date THEN 'bad_range'
             WHEN r.hotel_id IS NULL THEN 'no_such_room'
             WHEN NOT EXISTS (SELECT 1 FROM customer_t c WHERE c.customer_id = q.customer_id) THEN 'no_such_customer'
             END AS reason
        FROM booking_req q LEFT JOIN room r ON r.room_id = q.room_id""",
}


def _intake(T):
    req = booking_requests(T["_raw"]["events"], T["_raw"]["part"])
    return transitions.intake_bookings(T, req, INTAKE_AS_OF)


@register("intake_bookings", """
SELECT request_id, arrival, room_id, customer_id, start_date, end_date, hotel_id,
       reason IS NULL AS qualified, reason FROM intake""", BOOKING_REQ)
def q_intake(T):
    return _intake(T)


@register("first_touch_hotel", """
SELECT customer_id, hotel_id FROM (
  SELECT i.customer_id, i.hotel_id,
         row_number() OVER (PARTITION BY i.customer_id ORDER BY i.arrival, i.request_id) AS rn
  FROM intake i JOIN customer_t c ON c.customer_id = i.customer_id
  WHERE i.reason IS NULL AND c.hotel_id IS NULL) WHERE rn = 1""", BOOKING_REQ)
def q_first_touch(T):
    return transitions.first_touch_hotel(T, _intake(T))


_B2R = {"b2r": f"""SELECT (SELECT coalesce(max(renting_id), 0) FROM renting) + row_number() OVER (ORDER BY booking_id) AS renting_id,
  room_id, customer_id, created_by_employee_id AS employee_id, booking_id AS source_booking_id,
  start_date, end_date, 'active' AS status
FROM booking WHERE status = 'checked_in' AND start_date <= DATE '{AS_OF}' AND DATE '{AS_OF}' < end_date"""}


def _rule_exists(key, other, me="n"):
    tab = "open_booking" if other == "booking" else "active_renting"
    cond = f"o.{key} = {me}.{key} AND {ovl(me, 'o')}"
    if other == "renting":
        cond += f" AND o.renting_id <> {me}.renting_id"
    else:
        cond += f" AND ({me}.source_booking_id IS NULL OR o.booking_id <> {me}.source_booking_id)"
    return f"EXISTS (SELECT 1 FROM {tab} o WHERE {cond})"


@register("bookings_to_rentings", f"""
SELECT n.*, r.reason, r.reason IS NULL AS accepted FROM b2r n,
LATERAL (SELECT CASE WHEN {_rule_exists('room_id', 'renting')} THEN 'room_renting'
     WHEN {_rule_exists('room_id', 'booking')} THEN 'room_booking'
     WHEN {_rule_exists('customer_id', 'renting')} THEN 'customer_renting'
     WHEN {_rule_exists('customer_id', 'booking')} THEN 'customer_booking' END AS reason) r""", _B2R)
def q_to_rentings(T):
    return transitions.bookings_to_rentings(T, AS_OF)


@register("one_manager_per_hotel", """
SELECT employee_id, hotel_id, rn = 1 AS accepted FROM (
  SELECT employee_id, hotel_id, pri, row_number() OVER (PARTITION BY hotel_id ORDER BY pri, employee_id) AS rn
  FROM (SELECT employee_id, hotel_id, 0 AS pri FROM employee WHERE is_manager AND role_title <> 'Concierge'
        UNION ALL SELECT employee_id, hotel_id, 1 FROM employee WHERE role_title = 'Concierge')) WHERE pri = 1""")
def q_one_manager(T):
    e = T["employee"]
    # promotion requests: every concierge asks to become manager
    changes = e.filter(F.col("role_title") == "Concierge").withColumn("is_manager", F.lit(True))
    return tables.one_manager_per_hotel(e, changes)


# ---------------------------------------------------------------- admission (no SQL form)
def admission_requests(T) -> DataFrame:
    return booking_requests(T["_raw"]["events"], T["_raw"]["part"])


def admit_requests(T, requests: DataFrame) -> DataFrame:
    """J2 over ``requests`` against the stored blocking stays of ``T``."""
    from innkeep.operators.admission import admit
    from innkeep.plans.conflicts import find_conflicts, first_violation
    cand = requests.select((-F.col("request_id") - 1).alias("booking_id"), "request_id",
                           "room_id", "customer_id", "start_date", "end_date")
    hits = first_violation(find_conflicts(T, {"booking": cand.drop("request_id")}, sides=("booking",)))
    pre = hits.select((-F.col("record_id") - 1).alias("request_id"), F.col("rule").alias("reason"))
    return admit(requests, pre)


@register("admission", None)
def q_admission(T):
    return admit_requests(T, admission_requests(T))


# ---------------------------------------------------------------- data quality
from innkeep.functions.intake import EMAIL_RE, FALSE_WORDS, TRUE_WORDS  # noqa: E402
from innkeep.plans import quality  # noqa: E402
from innkeep.sources.schemas import ENUMS, FOREIGN_KEYS, PRIMARY_KEYS, UNIQUE_KEYS  # noqa: E402

# Intake specs over driver text columns: (source, key columns, {column: rule}).
INTAKE_SPECS = [
    ("conversations", ["conv_id", "turn"], {"role": ("enum", ["user", "assistant"]),
                                            "text": ("string", 1000)}),
    ("pages", ["page_id"], {"host": ("username",)}),
    ("documents", ["doc_id"], {"lang": ("enum", ["en", "fr"]), "n_chars": ("int", 1),
                               "text": ("string", 20000)}),
    ("events", ["event_id"], {"user_id": ("int", 1), "props": ("int", 1), "value": ("number", 20.0),
                              "day": ("date",), "flag": ("bool",)}),
    ("customer", ["c_custkey"], {"phone": ("phone",), "c_name": ("sin",), "mail": ("email",), "c_mktsegment": ("checkbox",)}),
]


def _intake_frames(raw):
    pages = raw["pages"].select("page_id", F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"))
    docs = raw["documents"].select("doc_id", "lang", F.col("n_chars").cast("string").alias("n_chars"), "text")
    e = F.col("event_id")
    day = F.date_format("ts", "yyyy-MM-dd")
    ev = raw["events"].select(
        "event_id", F.col("user_id").cast("string").alias("user_id"), "props",
        F.concat(F.floor(F.col("value")).cast("bigint").cast("string"), F.lit(".5 CAD")).alias("value"),
        F.when(e % 3 == 0, F.concat(F.lit(" "), day)).when(e % 3 == 1, F.concat(F.substring(day, 1, 8), F.lit("32"))).otherwise(F.col("event_type")).alias("day"),
        F.when(e % 4 == 0, "Yes").when(e % 4 == 1, " off ").when(e % 4 == 2, "0").otherwise(F.col("event_type")).alias("flag"))
    c = F.col("c_custkey")
    cu = raw["customer"].select("c_custkey", "c_name", "c_mktsegment", F.concat(F.lit("(613) 55-"), (c * 97 % 100000).cast("string")).alias("phone"), F.when(c % 3 == 0, F.concat(F.lit(" Guest"), c.cast("string"), F.lit("@Mail.example ")))
                                .when(c % 3 == 1, F.concat(F.lit("guest"), c.cast("string"), F.lit("@mail"))).otherwise(F.lit(" ")).alias("mail"))
    return {"conversations": raw["conversations"], "pages": pages, "documents": docs, "events": ev, "customer": cu}


EMAIL_SQL = EMAIL_RE.replace("'", "''")
BOOL_SQL = ", ".join(f"'{w}'" for w in (*TRUE_WORDS, *FALSE_WORDS))


def _trim_sql(x):
    return f"regexp_replace(coalesce({x}, ''), '^\\s+|\\s+$', '', 'g')"


def _reason_sql(col, rule, *args):
    t = _trim_sql(col)
    if rule == "string":
        return f"CASE WHEN length({t}) = 0 THEN 'required' WHEN length({t}) > {args[0]} THEN 'too_long' END"
    if rule == "enum":
        vals = ", ".join(f"'{v}'" for v in args[0])
        return f"CASE WHEN {t} NOT IN ({vals}) THEN 'not_allowed' END"
    if rule == "username":
        return f"CASE WHEN NOT regexp_matches(lower({t}), '^[a-z0-9._-]{{3,60}}$') THEN 'invalid_username' END"
    if rule == "int":
        p = f"regexp_extract({t}, '^[+-]?[0-9]+', 0)"
        return (f"CASE WHEN TRY_CAST(nullif({p}, '') AS DECIMAL(38,0)) IS NULL "
                f"OR TRY_CAST(nullif({p}, '') AS DECIMAL(38,0)) < {args[0]} THEN 'not_int_ge_min' END")
    digits = f"regexp_replace(coalesce({col}, ''), '[^0-9]', '', 'g')"
    if rule == "phone":
        return f"CASE WHEN length({digits}) <> 10 THEN 'phone_not_10_digits' END"
    if rule == "sin":
        return f"CASE WHEN length({digits}) <> 9 THEN 'sin_not_9_digits' END"
    if rule == "email":
        return (f"CASE WHEN length({t}) = 0 THEN 'required' WHEN length({t}) > 120 THEN 'too_long' "
                f"WHEN NOT regexp_matches(lower({t}), '{EMAIL_SQL}') THEN 'invalid_email' END")
    if rule == "number":
        p = f"TRY_CAST(nullif(regexp_extract({t}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)', 0), '') AS DOUBLE)"
        return f"CASE WHEN {p} IS NULL OR {p} < {args[0]} THEN 'not_number_ge_min' END"
    if rule == "date":
        return (f"CASE WHEN NOT regexp_matches({t}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') OR TRY_CAST({t} AS DATE) IS NULL "
                f"THEN 'invalid_date' END")
    if rule == "bool":
        return f"CASE WHEN lower({t}) NOT IN ({BOOL_SQL}) THEN 'invalid_boolean' END"
    if rule == "checkbox":
        return "CAST(NULL AS VARCHAR)"
    raise ValueError(rule)


def _intake_sql():
    srcs = {"conversations": "SELECT conv_id, turn, role, text FROM conversations",
            "pages": "SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS host FROM pages",
            "documents": "SELECT doc_id, lang, CAST(n_chars AS VARCHAR) AS n_chars, text FROM documents",
            "events": """SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, props,
                CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '.5 CAD' AS value,
                CASE event_id % 3 WHEN 0 THEN ' ' || strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-') || '32' ELSE event_type END AS day,
                CASE event_id % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN ' off ' WHEN 2 THEN '0' ELSE event_type END AS flag FROM events""",
            "customer": """SELECT c_custkey, c_name, c_mktsegment, '(613) 55-' || CAST(c_custkey * 97 % 100000 AS VARCHAR) AS phone,
                CASE c_custkey % 3 WHEN 0 THEN ' Guest' || CAST(c_custkey AS VARCHAR) || '@Mail.example '
                     WHEN 1 THEN 'guest' || CAST(c_custkey AS VARCHAR) || '@mail' ELSE ' ' END AS mail FROM customer"""}
    parts = []
    for src, keys, spec in INTAKE_SPECS:
        key = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
        for col, (rule, *args) in spec.items():
            r = _reason_sql(col, rule, *args)
            parts.append(f"SELECT '{src}' AS source, {key} AS row_key, '{col}' AS column_name, reason "
                         f"FROM (SELECT *, {r} AS reason FROM ({srcs[src]})) WHERE reason IS NOT NULL")
    return "\nUNION ALL\n".join(parts)


@register("intake_quality", _intake_sql())
def q_intake_quality(T):
    frames = _intake_frames(T["_raw"])
    out = None
    for src, keys, spec in INTAKE_SPECS:
        _clean, rej = quality.normalise_intake(frames[src], spec, keys)
        r = rej.select(F.lit(src).alias("source"),
                       F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("row_key"),
                       F.col("column").alias("column_name"), "reason")
        out = r if out is None else out.unionByName(r)
    return out


_AUDIT_NAMES = {"customer": "customer_t", "person": "person_raw"}
_AUDIT_TABLES = ["hotel_chain", "hotel", "person", "customer", "employee", "auth_account", "room",
                 "booking", "renting", "payment"]
_AUDIT_CHECKS = {
    "hotel": [("check_category", "category BETWEEN 1 AND 5"), ("check_total_rooms", "total_rooms >= 1")],
    "person": [("check_id_type", "id_type = 'SIN'"), ("check_legal_id", "regexp_matches(legal_id, '^[0-9]{9}$')")],
    "room": [("check_base_price", "base_price > 0")],
    "booking": [("check_dates", "end_date > start_date")],
    "renting": [("check_dates", "end_date > start_date")],
    "payment": [("check_amount", "amount > 0")],
    "auth_account": [("check_role_ids", """CASE WHEN role = 'admin' THEN employee_id IS NULL AND customer_id IS NULL
        WHEN role IN ('manager', 'employee') THEN employee_id IS NOT NULL AND customer_id IS NULL
        WHEN role = 'customer' THEN customer_id IS NOT NULL AND employee_id IS NULL ELSE true END""")],
}


def _audit_sql():
    def agg(table, rule, src, cols):
        k = "concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + ")"
        return (f"SELECT '{table}' AS table_name, '{rule}' AS rule, count(*) AS n_violations, "
                f"min({k}) AS sample_key FROM ({src}) HAVING count(*) > 0")
    parts = []
    for t in _AUDIT_TABLES:
        n = _AUDIT_NAMES.get(t, t)
        pk = PRIMARY_KEYS[t]
        parts.append(agg(t, "pk_null", f"SELECT * FROM {n} WHERE {pk[0]} IS NULL", pk))
        parts.append(agg(t, "pk_duplicate", f"SELECT {pk[0]} FROM {n} WHERE {pk[0]} IS NOT NULL "
                                            f"GROUP BY {pk[0]} HAVING count(*) > 1", pk))
        for uk in UNIQUE_KEYS.get(t, []):
            cols = ", ".join(uk)
            nn = " AND ".join(f"{c} IS NOT NULL" for c in uk)
            parts.append(agg(t, "unique_" + "_".join(uk),
                             f"SELECT {cols} FROM {n} WHERE {nn} GROUP BY {cols} HAVING count(*) > 1", uk))
        for (tab, col), values in ENUMS.items():
            if tab == t:
                vals = ", ".join(f"'{v}'" for v in values)
                parts.append(agg(t, f"enum_{col}", f"SELECT * FROM {n} WHERE {col} IS NOT NULL AND {col} NOT IN ({vals})", pk))
        for rule, cond in _AUDIT_CHECKS.get(t, []):
            parts.append(agg(t, rule, f"SELECT * FROM {n} WHERE NOT coalesce({cond}, true)", pk))
    for child, ccol, parent, pcol, _a in FOREIGN_KEYS:
        if child in _AUDIT_TABLES and parent in _AUDIT_TABLES:
            cn, pn = _AUDIT_NAMES.get(child, child), _AUDIT_NAMES.get(parent, parent)
            parts.append(agg(child, f"fk_{ccol}", f"SELECT {ccol} FROM {cn} c WHERE {ccol} IS NOT NULL AND NOT EXISTS "
                                                  f"(SELECT 1 FROM {pn} p WHERE p.{pcol} = c.{ccol})", [ccol]))
    return "\nUNION ALL\n".join(parts)


@register("constraint_audit", _audit_sql())
def q_audit(T):
    T2 = {k: v for k, v in T.items() if k in _AUDIT_TABLES}
    T2["person"] = T["person_raw"]
    return quality.audit_constraints(T2, _AUDIT_TABLES)


# ---------------------------------------------------------------- upsert
# Every customer asks for a change: most for a new e-mail, some (credit in
# hand) for the one they have, every fiftieth for the next customer's.  That
# one is free only where the next customer gave it up before.
_UPSERT_CTES = {
    "chg": """SELECT p.legal_id, p.first_name, p.last_name, c.c_custkey AS k,
        CASE WHEN c_acctbal >= 0 THEN p.email
             WHEN c_custkey % 50 = 0 THEN 'customer' || CAST(c_custkey + 1 AS VARCHAR) || '@mail.example'
             ELSE 'new' || CAST(c_custkey AS VARCHAR) || '@mail.example' END AS email
        FROM customer c JOIN person p ON p.legal_id = lpad(CAST(200000000 + c_custkey AS VARCHAR), 9, '0')""",
    "rej": """SELECT g.legal_id FROM chg g JOIN customer me ON me.c_custkey = g.k JOIN customer nxt ON nxt.c_custkey = g.k + 1
        WHERE me.c_acctbal < 0 AND g.k % 50 = 0 AND NOT (g.k % 100 = 50 AND nxt.c_acctbal < 0)""",
}


def _upserted(T):
    c = F.col("c_custkey")
    cur = T["person"].select("legal_id", "first_name", "last_name", "email")
    raw = T["_raw"]["customer"].select(_lpad_id(200000000, c).alias("legal_id"), "c_custkey", "c_acctbal")
    new = F.when(F.col("c_acctbal") >= 0, F.col("email")) \
        .when(c % 50 == 0, F.concat(F.lit("customer"), (c + 1).cast("string"), F.lit("@mail.example"))) \
        .otherwise(F.concat(F.lit("new"), c.cast("string"), F.lit("@mail.example")))
    changes = cur.join(raw, "legal_id").select("legal_id", "first_name", "last_name", new.alias("email"),
                                               (c + F.when(c % 100 == 50, 10).otherwise(0)).alias("changed_at"))
    return tables.upsert(cur, changes, ["legal_id"], "changed_at", [["email"]])


@register("upsert", """
SELECT p.legal_id, p.first_name, p.last_name,
       CASE WHEN g.legal_id IS NULL OR p.legal_id IN (SELECT legal_id FROM rej) THEN p.email ELSE g.email END AS email
FROM person p LEFT JOIN chg g ON g.legal_id = p.legal_id""", _UPSERT_CTES)
def q_upsert(T):
    return _upserted(T)[0]


def _register(kind: str):
    def run(T) -> DataFrame:
        """Every change of a register with its decision; tests replay them."""
        from innkeep.plans import registers
        from innkeep.sources.bindings import register_changes
        return getattr(registers, f"write_{kind}s")(T, register_changes(T["_raw"])[kind]).decided
    return run


for _kind in ("customer", "employee", "hotel", "room"):
    _REG[f"register_{_kind}s"] = (_register(_kind), None)


# ---------------------------------------------------------------- streams (L1-L3)
from innkeep.streaming import jobs as streams  # noqa: E402


def _stage_changes(T):
    spark = T["booking"].sparkSession
    decided = _decided(T)
    changes = transitions.transition_changes(T, decided)
    path = streams.scratch_dir(spark, "changes")
    return streams.stage_files(changes, path, 4)  # (path, files per trigger)


def q_stream_archive(T):
    spark, T = T["booking"].sparkSession, _stays_once(T)
    src, per = _stage_changes(T)
    return streams.archive_stream(spark, T, src, arch.archive_backfill(T),
                                  streams.scratch_dir(spark, "archive-out"),
                                  streams.scratch_dir(spark, "archive-ckpt"), files_per_trigger=per)


_REG["stream_archive"] = (q_stream_archive, _REG["archive_transitions"][1])


@register("stream_status", f"""
SELECT DISTINCT r.room_id, CASE
  WHEN r.current_status = 'maintenance' THEN 'maintenance'
  WHEN EXISTS (SELECT 1 FROM active_renting x WHERE x.room_id = r.room_id
               AND x.start_date <= DATE '{AS_OF}' AND DATE '{AS_OF}' < x.end_date) THEN 'rented'
  WHEN EXISTS (SELECT 1 FROM booking2 b WHERE b.room_id = r.room_id AND b.status IN ('reserved', 'checked_in')
               AND b.start_date <= DATE '{AS_OF}' AND DATE '{AS_OF}' < b.end_date) THEN 'booked'
  ELSE 'available' END AS status
FROM room r
WHERE r.room_id IN (SELECT b.room_id FROM trans_out o JOIN booking b ON b.booking_id = o.booking_id WHERE o.accepted)""",
          {**TRANS_CTES, "booking2": """SELECT b.booking_id, b.room_id, b.customer_id,
        arg_max(s.status, s.n) AS status, arg_max(s.start_date, s.n) AS start_date, arg_max(s.end_date, s.n) AS end_date
        FROM booking b JOIN trans_state s ON s.booking_id = b.booking_id GROUP BY 1, 2, 3"""})
def q_stream_status(T):
    spark, T = T["booking"].sparkSession, _stays_once(T)
    src, per = _stage_changes(T)
    return streams.latest_status(streams.status_stream(
        spark, T, src, AS_OF, streams.scratch_dir(spark, "status-out"),
        streams.scratch_dir(spark, "status-ckpt"), files_per_trigger=per))


@register("stream_admission", None)
def q_stream_admission(T):
    spark, T = T["booking"].sparkSession, _stays_once(T)
    req = admission_requests(T)
    src, per = streams.stage_files(req, streams.scratch_dir(spark, "requests"), 4)

    def intake(df):
        return transitions.intake_bookings(T, df, INTAKE_AS_OF)

    landed = streams.land_requests(spark, src, intake, streams.scratch_dir(spark, "landed-out"),
                                   streams.scratch_dir(spark, "landed-ckpt"), files_per_trigger=per)
    qualified = landed.filter("qualified")
    decided = streams.admit_landed(T, qualified, admit_requests)
    rejected = landed.filter(~F.col("qualified")).select(
        "request_id", F.lit(False).alias("accepted"), "reason", F.lit(0).alias("round"))
    return decided.unionByName(rejected)


def _arrivals(T) -> DataFrame:
    from innkeep.sources.bindings import arrival_requests
    return arrival_requests(T["_raw"]["events"], T["_raw"]["part"], T["booking"])


@register("admission_both_kinds", None)
def q_admission_both_kinds(T):
    """J2 over bookings and rentings in one order; tests replay it."""
    from innkeep.plans.arrivals import admit_all
    T = _stays_once(T)
    return admit_all(T, _arrivals(T))


@register("stream_admission_both_kinds", None)
def q_stream_admission_both_kinds(T):
    """L3: the same requests, decided micro-batch by micro-batch as they land."""
    from innkeep.plans.arrivals import admit_all, with_accepted
    spark, T = T["booking"].sparkSession, _stays_once(T)
    src = streams.stage_in_order(_arrivals(T), streams.scratch_dir(spark, "arrivals"), ["arrival", "request_id"], 4)
    decided = streams.admission_stream(spark, T, src, streams.scratch_dir(spark, "admission"), admit_all, with_accepted)
    return decided.select("request_id", "record_type", "accepted", "reason")


def stay_changes(T) -> DataFrame:
    """A day's changes of both tables, by key: bookings are cancelled, moved by three days, deleted or
    copied one room on; rentings are completed, deleted or copied five days later."""
    cols = ["room_id", "status", "start_date", "end_date"]
    none = {c: F.lit(None).cast(t) for c, t in zip(cols, ("bigint", "string", "date", "date"), strict=True)}

    def change(name: str, op: str, picked, new: dict | None, old: bool) -> DataFrame:
        values = none if new is None else {**{c: F.col(c) for c in cols}, **new}
        return T[name].filter(picked).select(
            F.lit(name).alias("record_type"), F.lit(op).alias("op"), F.col(f"{name}_id").alias("id"),
            *[values[c].alias(c) for c in cols], *[(F.col(c) if old else none[c]).alias(f"old_{c}") for c in cols])

    b, r = F.col("booking_id") % 5, F.col("renting_id") % 7
    later = lambda n: {c: F.date_add(c, n) for c in ("start_date", "end_date")}
    parts = [change("booking", "update", b == 0, {"status": F.lit("cancelled")}, True),
             change("booking", "update", b == 1, later(3), True), change("booking", "delete", b == 2, None, True),
             change("booking", "insert", b == 3, {"room_id": F.col("room_id") + 1}, False),
             change("renting", "update", r == 0, {"status": F.lit("completed")}, True),
             change("renting", "delete", r == 1, None, True), change("renting", "insert", r == 2, later(5), False)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("stream_status_both", f"""
SELECT r.room_id, CASE
  WHEN r.current_status = 'maintenance' THEN 'maintenance'
  WHEN EXISTS (SELECT 1 FROM renting2 x WHERE x.room_id = r.room_id AND x.status = 'active'
               AND x.start_date <= DATE '{AS_OF}' AND DATE '{AS_OF}' < x.end_date) THEN 'rented'
  WHEN EXISTS (SELECT 1 FROM booking2 b WHERE b.room_id = r.room_id AND b.status IN ('reserved', 'checked_in')
               AND b.start_date <= DATE '{AS_OF}' AND DATE '{AS_OF}' < b.end_date) THEN 'booked'
  ELSE 'available' END AS status
FROM room r WHERE r.room_id IN (SELECT room_id FROM touched)""", {
    "booking2": """SELECT room_id, CASE WHEN booking_id % 5 = 0 THEN 'cancelled' ELSE status END AS status,
        start_date + CASE WHEN booking_id % 5 = 1 THEN 3 ELSE 0 END AS start_date,
        end_date + CASE WHEN booking_id % 5 = 1 THEN 3 ELSE 0 END AS end_date FROM booking WHERE booking_id % 5 <> 2
        UNION ALL SELECT room_id + 1, status, start_date, end_date FROM booking WHERE booking_id % 5 = 3""",
    "renting2": """SELECT room_id, CASE WHEN renting_id % 7 = 0 THEN 'completed' ELSE status END AS status, start_date, end_date
        FROM renting WHERE renting_id % 7 <> 1
        UNION ALL SELECT room_id, status, start_date + 5, end_date + 5 FROM renting WHERE renting_id % 7 = 2""",
    "touched": """SELECT room_id + CASE WHEN booking_id % 5 = 3 THEN 1 ELSE 0 END AS room_id FROM booking WHERE booking_id % 5 <= 3
        UNION SELECT room_id FROM renting WHERE renting_id % 7 <= 2"""})
def q_stream_status_both(T):
    """L2 over the changes of both tables, dealt over four micro-batches in no order."""
    spark, T = T["booking"].sparkSession, _stays_once(T)
    src, per = streams.stage_files(streams.dealt(stay_changes(T), 4), streams.scratch_dir(spark, "both"), 4)
    return streams.latest_status(streams.status_stream_both(
        spark, T, src, AS_OF, streams.scratch_dir(spark, "both-out"), streams.scratch_dir(spark, "both-ckpt"), files_per_trigger=per))


def renting_changes(T) -> DataFrame:
    """Every renting ends: change records with an id and an order, some delivered twice."""
    r = T["renting"]
    ended = r.select(*[c for c in r.columns if c != "status"], F.col("status").alias("old_status"),
                     F.when(F.col("renting_id") % 3 == 0, "cancelled").otherwise("completed").alias("status"),
                     F.lit("update").alias("op"), F.col("renting_id").alias("seq"), F.col("renting_id").alias("change_id"))
    return ended.unionByName(ended.filter(F.col("renting_id") % 4 == 0))


@register("stream_renting_archive", snap_sql(
    "renting", "(SELECT x.renting_id, x.room_id, x.customer_id, x.source_booking_id, x.start_date, x.end_date, "
    "CASE WHEN x.renting_id % 3 = 0 THEN 'cancelled' ELSE 'completed' END AS status FROM renting x)",
    "s.renting_id NOT IN (SELECT source_renting_id FROM archive_bf WHERE record_type = 'renting')"))
def q_stream_renting_archive(T):
    """L1 with bounded state over the renting changes; what was archived before stays out."""
    spark, T = T["renting"].sparkSession, _stays_once(T)
    src, per = streams.stage_files(streams.dealt(renting_changes(T), 4), streams.scratch_dir(spark, "ended"), 4)
    return streams.archive_stream_bounded(spark, T, src, arch.archive_backfill(T), streams.scratch_dir(spark, "ended-out"),
                                          "renting", files_per_trigger=per)[0]


# ---------------------------------------------------------------- guards, accounts, migration
@register("delete_guards", """
SELECT 'customer' AS entity, c.customer_id AS id,
  NOT (EXISTS (SELECT 1 FROM open_booking b WHERE b.customer_id = c.customer_id)
       OR EXISTS (SELECT 1 FROM active_renting x WHERE x.customer_id = c.customer_id)) AS can_delete,
  CASE WHEN EXISTS (SELECT 1 FROM open_booking b WHERE b.customer_id = c.customer_id) THEN 'open_booking'
       WHEN EXISTS (SELECT 1 FROM active_renting x WHERE x.customer_id = c.customer_id) THEN 'active_renting' END AS reason
FROM customer_t c
UNION ALL
SELECT 'employee', e.employee_id,
  NOT (EXISTS (SELECT 1 FROM renting x WHERE x.employee_id = e.employee_id)
       OR EXISTS (SELECT 1 FROM payment p WHERE p.employee_id = e.employee_id)),
  CASE WHEN EXISTS (SELECT 1 FROM renting x WHERE x.employee_id = e.employee_id) THEN 'referenced_by_renting'
       WHEN EXISTS (SELECT 1 FROM payment p WHERE p.employee_id = e.employee_id) THEN 'referenced_by_payment' END
FROM employee e""")
def q_guards(T):
    return tables.delete_guards(T)


def account_requests(T) -> DataFrame:
    """Staff-account status requests from ``events``: the acting staff
    member is ``user_id`` (admin when user_id % 10 = 0), the target is
    ``(event_id * 31) % #suppliers``, disable when event_id % 3 = 0."""
    ev = T["_raw"]["events"]
    n_staff = T["_raw"]["supplier"].agg(F.count(F.lit(1))).scalar()
    u, e = F.col("user_id"), F.col("event_id")
    emp = T["employee"].select(F.col("employee_id").alias("user_id"), "is_manager")
    acts = ev.join(emp, "user_id", "left")
    role = F.when(u % 10 == 0, "admin").when(F.col("is_manager"), "manager") \
        .when(F.col("is_manager").isNotNull(), "employee").otherwise("none")
    return acts.select(e.alias("request_id"), role.alias("actor_role"),
                       u.alias("actor_employee_id"), (u * 2).alias("actor_account_id"),
                       ((e * 31) % n_staff).alias("target_employee_id"), (e % 3 != 0).alias("is_active"))


@register("account_status", """
SELECT q.request_id, q.target_employee_id, a.account_id, reason IS NULL AS accepted, reason, q.is_active
FROM (SELECT ev.event_id AS request_id,
        CASE WHEN ev.user_id % 10 = 0 THEN 'admin' WHEN e.is_manager THEN 'manager'
             WHEN e.is_manager IS NOT NULL THEN 'employee' ELSE 'none' END AS actor_role,
        ev.user_id AS actor_employee_id, ev.user_id * 2 AS actor_account_id,
        (ev.event_id * 31) % (SELECT count(*) FROM supplier) AS target_employee_id,
        ev.event_id % 3 <> 0 AS is_active, e.hotel_id AS actor_hotel
      FROM events ev LEFT JOIN employee e ON e.employee_id = ev.user_id) q
LEFT JOIN (SELECT * FROM auth_account WHERE role IN ('employee', 'manager')) a ON a.employee_id = q.target_employee_id
LEFT JOIN employee t ON t.employee_id = q.target_employee_id,
LATERAL (SELECT CASE WHEN a.account_id IS NULL THEN 'not_found'
     WHEN q.actor_role = 'manager' AND a.role <> 'employee' THEN 'managers_only_employees'
     WHEN q.actor_role = 'manager' AND t.hotel_id IS DISTINCT FROM q.actor_hotel THEN 'other_hotel'
     WHEN q.actor_role NOT IN ('admin', 'manager') THEN 'no_permission'
     WHEN NOT q.is_active AND q.actor_account_id = a.account_id THEN 'own_account' END AS reason) r""")
def q_account_status(T):
    return tables.staff_account_status(T, account_requests(T))


@register("migrate_fk", """
SELECT c.c_custkey AS customer_id, p.legal_id
FROM customer c LEFT JOIN (SELECT c_custkey + 1 AS person_id,
                                  lpad(CAST(200000000 + c_custkey AS VARCHAR), 9, '0') AS legal_id FROM customer) p
  ON p.person_id = c.c_custkey + 1""")
def q_migrate(T):
    raw = T["_raw"]["customer"]
    legacy_customer = raw.select(F.col("c_custkey").alias("customer_id"),
                                 (F.col("c_custkey") + 1).alias("person_id"))
    legacy_person = raw.select((F.col("c_custkey") + 1).alias("person_id"),
                               _lpad_id(200000000, F.col("c_custkey")).alias("legal_id"))
    return repair.migrate_fk(legacy_customer, legacy_person)


# ---------------------------------------------------------------- more reports
@register("home_counters", """
SELECT (SELECT count(*) FROM hotel) AS hotels, (SELECT count(*) FROM room) AS rooms,
       (SELECT count(*) FROM customer_t) AS customers, (SELECT count(*) FROM employee) AS employees""")
def q_home(T):
    return reports.home_counters(T)


@register("search_page", f"""
SELECT s.*, n.next_start, n.next_end, n.next_type, n.next_source_id
FROM (SELECT r.room_id, r.room_number, r.hotel_id, h.hotel_name, h.chain_id, c.chain_name, h.area,
             h.category, r.capacity, r.base_price, r.current_status,
             coalesce(nullif(trim(r.issues, ' '), ''), 'None reported') AS issues_label
      FROM room r JOIN hotel h USING (hotel_id) JOIN hotel_chain c USING (chain_id)
      WHERE r.capacity = 'double' AND r.base_price <= 1500
      ORDER BY h.area, h.hotel_name, r.base_price, r.room_id LIMIT 300) s
LEFT JOIN (SELECT room_id, start_date AS next_start, end_date AS next_end, block_type AS next_type,
                  source_id AS next_source_id FROM {BLOCKS_SQL}
           QUALIFY row_number() OVER (PARTITION BY room_id ORDER BY start_date, end_date, block_type, source_id) = 1) n
  ON n.room_id = s.room_id""")
def q_search_page(T):
    return reports.search_page(T, 300, capacity="double", max_price=1500, as_of=AS_OF)


@register("search_page_ranges", f"""
SELECT b.room_id, b.start_date, b.end_date, b.block_type AS source_type FROM {BLOCKS_SQL} b
WHERE b.end_date > DATE '{AS_OF}' AND b.room_id IN (
  SELECT r.room_id FROM room r JOIN hotel h USING (hotel_id) JOIN hotel_chain c USING (chain_id)
  WHERE r.capacity = 'double' AND r.base_price <= 1500 ORDER BY h.area, h.hotel_name, r.base_price, r.room_id LIMIT 300)""")
def q_search_page_ranges(T):
    return reports.search_page_ranges(T, 300, capacity="double", max_price=1500, as_of=AS_OF)


# When the two parts of the stored archive are appended.
ARCHIVED = {"booking": "1998-06-15 01:00:00", "renting": "1998-06-15 02:00:00"}


def _stored_archive(T):
    """A3: finished bookings, then finished rentings, appended to a stored archive and read back."""
    from innkeep.sources.sinks import append_archive
    spark, T = T["booking"].sparkSession, _stays_once(T)
    path, rows = streams.scratch_dir(spark, "archive"), arch.archive_backfill(T)
    for kind in ("booking", "renting", "booking"):  # the second time appends nothing
        append_archive(spark, rows.filter(F.col("record_type") == kind), path, ARCHIVED[kind])
    return spark.read.parquet(path)


_STORED_ARCHIVE = f"""(SELECT a.*, CASE WHEN record_type = 'booking' THEN TIMESTAMP '{ARCHIVED["booking"]}' ELSE TIMESTAMP '{ARCHIVED["renting"]}' END AS archived_at,
    row_number() OVER (ORDER BY record_type, source_booking_id NULLS FIRST, source_renting_id NULLS FIRST) AS archive_id FROM archive_bf a)"""


@register("archive_page", f"""
SELECT a.* FROM {_STORED_ARCHIVE} a JOIN hotel h ON h.hotel_name = a.hotel_name JOIN hotel_chain c ON c.chain_id = h.chain_id AND c.chain_name = a.chain_name
WHERE h.hotel_id = {POLICY_HOTEL} ORDER BY a.archived_at DESC, a.archive_id DESC LIMIT 400""")
def q_archive_page(T):
    return reports.archive_page(_stored_archive(T), T, POLICY_HOTEL, 400)


@register("archive_page_all", f"SELECT a.* FROM {_STORED_ARCHIVE} a ORDER BY a.archived_at DESC, a.archive_id DESC LIMIT 700")
def q_archive_page_all(T):
    return reports.archive_page(_stored_archive(T), T)


@register("archive_history", f"""
SELECT a.*, CASE WHEN a.record_type = 'booking' THEN 'B#' || CAST(a.source_booking_id AS VARCHAR)
                 ELSE 'R#' || CAST(a.source_renting_id AS VARCHAR) END AS source_label
FROM archive_bf a JOIN hotel h ON h.hotel_name = a.hotel_name JOIN hotel_chain c ON c.chain_id = h.chain_id
  AND c.chain_name = a.chain_name
WHERE h.hotel_id = {POLICY_HOTEL}
ORDER BY a.end_date DESC, a.record_type, coalesce(a.source_renting_id, a.source_booking_id) DESC LIMIT 400""")
def q_archive_history(T):
    return reports.archive_history(arch.archive_backfill(T), T, POLICY_HOTEL, 400)


@register("staff_register", """
SELECT e.employee_id, e.legal_id, p.first_name, p.last_name, p.email, p.phone, e.hotel_id, h.hotel_name,
       e.role_title, e.is_manager, a.username, a.is_active, CAST(NULL AS VARCHAR) AS password_plain
FROM employee e JOIN person p ON p.legal_id = e.legal_id JOIN hotel h ON h.hotel_id = e.hotel_id
LEFT JOIN (SELECT * FROM auth_account WHERE role IN ('manager', 'employee')) a ON a.employee_id = e.employee_id""")
def q_staff_register(T):
    return reports.staff_register(T)


@register("manager_team", f"""
SELECT e.employee_id, e.legal_id, p.first_name, p.last_name, p.email, p.phone, e.hotel_id, h.hotel_name,
       e.role_title, e.is_manager, a.username, a.is_active, CAST(NULL AS VARCHAR) AS password_plain
FROM employee e JOIN person p ON p.legal_id = e.legal_id JOIN hotel h ON h.hotel_id = e.hotel_id
LEFT JOIN (SELECT * FROM auth_account WHERE role IN ('manager', 'employee')) a ON a.employee_id = e.employee_id
WHERE e.hotel_id = {POLICY_HOTEL}""")
def q_team(T):
    return reports.staff_register(T, POLICY_HOTEL)


def customer_account_requests(T) -> DataFrame:
    """Customer-account status requests from ``events`` (actor = user_id as
    staff, admin when user_id % 10 = 0; target = (event_id * 17) % #customers)."""
    ev = T["_raw"]["events"]
    n_c = T["_raw"]["customer"].agg(F.count(F.lit(1))).scalar()
    emp = T["employee"].select(F.col("employee_id").alias("user_id"), "is_manager")
    u, e = F.col("user_id"), F.col("event_id")
    role = F.when(u % 10 == 0, "admin").when(F.col("is_manager"), "manager") \
        .when(F.col("is_manager").isNotNull(), "employee").otherwise("none")
    return ev.join(emp, "user_id", "left").select(
        e.alias("request_id"), role.alias("actor_role"), u.alias("actor_employee_id"),
        ((e * 17) % n_c).alias("customer_id"), (e % 3 != 0).alias("is_active"))


@register("customer_account_status", """
SELECT q.request_id, q.customer_id, r.reason IS NULL AS accepted, r.reason,
       CASE WHEN r.reason IS NULL THEN CASE WHEN a.account_id IS NULL THEN 'create' ELSE 'update' END END AS action,
       q.is_active
FROM (SELECT ev.event_id AS request_id,
        CASE WHEN ev.user_id % 10 = 0 THEN 'admin' WHEN e.is_manager THEN 'manager'
             WHEN e.is_manager IS NOT NULL THEN 'employee' ELSE 'none' END AS actor_role,
        e.hotel_id AS actor_hotel, (ev.event_id * 17) % (SELECT count(*) FROM customer) AS customer_id,
        ev.event_id % 3 <> 0 AS is_active
      FROM events ev LEFT JOIN employee e ON e.employee_id = ev.user_id) q
LEFT JOIN customer_t c ON c.customer_id = q.customer_id
LEFT JOIN (SELECT * FROM auth_account WHERE role = 'customer') a ON a.customer_id = q.customer_id,
LATERAL (SELECT CASE WHEN q.actor_role NOT IN ('employee', 'manager', 'admin') THEN 'no_permission'
     WHEN c.customer_id IS NULL THEN 'not_found'
     WHEN q.actor_role IN ('employee', 'manager') AND (c.hotel_id IS NULL OR q.actor_hotel IS NULL
          OR c.hotel_id <> q.actor_hotel) THEN 'other_hotel' END AS reason) r""")
def q_customer_account_status(T):
    return tables.customer_account_status(T, customer_account_requests(T))


# ---------------------------------------------------------------- boards and intake
@register("front_desk_page", f"""
SELECT booking_id, room_id, customer_id, start_date, end_date, status,
  end_date < DATE '{AS_OF}' AS is_overdue,
  status = 'reserved' AND start_date = DATE '{AS_OF}' AS can_check_in,
  status IN ('reserved', 'checked_in') AND end_date >= DATE '{AS_OF}' AS can_cancel,
  status = 'reserved' AND end_date >= DATE '{AS_OF}' AS can_update_dates,
  end_date < DATE '{AS_OF}' AS can_complete,
  regexp_replace(lower(status), '[^a-z_]', '_', 'g') AS status_slug
FROM open_booking WHERE room_id IN (SELECT room_id FROM room WHERE hotel_id = {POLICY_HOTEL})
ORDER BY end_date < DATE '{AS_OF}' DESC, start_date, booking_id DESC LIMIT 200""")
def q_front_desk(T):
    return reports.open_bookings_board(T, AS_OF, POLICY_HOTEL, limit=200)


@register("active_rentings_board", """
SELECT x.renting_id, x.room_id, rs.room_number, rs.hotel_id, rs.hotel_name, rs.chain_name, x.customer_id,
       cp.customer_full_name, x.start_date, x.end_date, strftime(x.start_date, '%Y-%m-%d') AS start_text,
       coalesce('Booking #' || CAST(x.source_booking_id AS VARCHAR), 'Walk-in / direct') AS origin_label
FROM active_renting x JOIN room_star rs ON rs.room_id = x.room_id JOIN cust_person cp ON cp.customer_id = x.customer_id""")
def q_active_board(T):
    return reports.active_rentings_board(T)


def renting_requests(T) -> DataFrame:
    """Walk-in renting requests from 'purchase' events: guest found by SIN
    (user_id), desk employee = event_id % #suppliers."""
    ev = T["_raw"]["events"].filter(F.col("event_type") == "purchase")
    n_rooms = T["_raw"]["part"].agg(F.expr("count(1) div 4")).scalar()
    n_staff = T["_raw"]["supplier"].agg(F.count(F.lit(1))).scalar()
    e = F.col("event_id")
    start = F.col("ts").cast("date")
    return ev.select(e.alias("request_id"), ((e * 7919) % n_rooms).alias("room_id"),
                     _lpad_id(200000000, F.col("user_id")).alias("customer_sin"),
                     (e % n_staff).alias("staff_employee_id"), start.alias("start_date"),
                     F.date_add(start, (e % 3).cast("int")).alias("end_date"))


@register("intake_rentings", """
SELECT q.request_id, q.room_id, c.customer_id, q.staff_employee_id, q.start_date, q.end_date,
       reason IS NULL AS qualified, reason
FROM (SELECT event_id AS request_id, (event_id * 7919) % (SELECT count(*) // 4 FROM part) AS room_id,
             lpad(CAST(200000000 + user_id AS VARCHAR), 9, '0') AS customer_sin,
             event_id % (SELECT count(*) FROM supplier) AS staff_employee_id,
             CAST(ts AS DATE) AS start_date, CAST(ts AS DATE) + CAST(event_id % 3 AS INTEGER) AS end_date
      FROM events WHERE event_type = 'purchase') q
LEFT JOIN room r ON r.room_id = q.room_id
LEFT JOIN customer_t c ON c.legal_id = q.customer_sin
LEFT JOIN employee e ON e.employee_id = q.staff_employee_id,
LATERAL (SELECT CASE WHEN q.end_date <= q.start_date THEN 'bad_range'
     WHEN r.hotel_id IS NULL THEN 'no_such_room' WHEN c.customer_id IS NULL THEN 'no_such_customer'
     WHEN e.hotel_id IS NULL OR e.hotel_id <> r.hotel_id THEN 'other_hotel'
     WHEN c.hotel_id IS NOT NULL AND c.hotel_id <> e.hotel_id THEN 'customer_of_other_hotel' END AS reason) z""")
def q_intake_rentings(T):
    return transitions.intake_rentings(T, renting_requests(T))


# Raw payment method strings entered at the desk, by event_id % 5.
RAW_METHODS = ["cash", "card", "debit", " card ", "Card"]


def payment_requests(T) -> DataFrame:
    """Payments from 'view' events: renting = first line of order event_id,
    amount = event value, raw method by event_id % 5, taken by employee
    user_id (an administrator when user_id % 10 = 0)."""
    ev = T["_raw"]["events"].filter(F.col("event_type") == "view")
    e, u = F.col("event_id"), F.col("user_id")
    m = F.element_at(F.array(*[F.lit(x) for x in RAW_METHODS]), (e % 5 + 1).cast("int"))
    return ev.select(e.alias("request_id"), (e * 10 + 1).alias("renting_id"), u.alias("employee_id"),
                     F.when(u % 10 == 0, "admin").otherwise("staff").alias("actor"),
                     F.col("value").try_cast("decimal(12,2)").alias("amount"), m.alias("method_raw"))


@register("intake_payments", """
SELECT q.request_id, q.renting_id, q.employee_id, q.amount,
       CASE trim(q.method_raw, ' ') WHEN 'card' THEN 'credit' WHEN 'cash' THEN 'cash' END AS method,
       reason IS NULL AS qualified, reason
FROM (SELECT event_id AS request_id, event_id * 10 + 1 AS renting_id, user_id AS employee_id,
             CASE WHEN user_id % 10 = 0 THEN 'admin' ELSE 'staff' END AS actor,
             TRY_CAST(value AS DECIMAL(12,2)) AS amount,
             CASE event_id % 5 WHEN 0 THEN 'cash' WHEN 1 THEN 'card' WHEN 2 THEN 'debit' WHEN 3 THEN ' card '
                  ELSE 'Card' END AS method_raw
      FROM events WHERE event_type = 'view') q
LEFT JOIN renting x ON x.renting_id = q.renting_id
LEFT JOIN room r ON r.room_id = x.room_id
LEFT JOIN employee e ON e.employee_id = q.employee_id,
LATERAL (SELECT CASE WHEN q.amount IS NULL OR q.amount < 0.01 THEN 'amount_not_positive'
     WHEN trim(q.method_raw, ' ') NOT IN ('cash', 'card') THEN 'invalid_method'
     WHEN x.status IS NULL THEN 'no_such_renting' WHEN x.status <> 'active' THEN 'renting_not_active'
     WHEN q.actor <> 'admin' AND (e.hotel_id IS NULL OR e.hotel_id <> r.hotel_id) THEN 'other_hotel'
     END AS reason) z""")
def q_intake_payments(T):
    return transitions.intake_payments(T, payment_requests(T))


@register("upsert_rejects", """
SELECT legal_id, 'unique_email' AS reason, 'email_registered' AS code FROM rej""", _UPSERT_CTES)
def q_upsert_rejects(T):
    return _upserted(T)[1].withColumn("code", quality.classify_violation("reason"))


@register("account_display_names", """
SELECT a.account_id, a.role,
  coalesce(pe.first_name || ' ' || pe.last_name, pc.first_name || ' ' || pc.last_name, 'Administrator') AS display_name
FROM auth_account a
LEFT JOIN employee e ON e.employee_id = a.employee_id LEFT JOIN person pe ON pe.legal_id = e.legal_id
LEFT JOIN customer_t c ON c.customer_id = a.customer_id LEFT JOIN person pc ON pc.legal_id = c.legal_id""")
def q_display_names(T):
    return reports.account_display_names(T)


@register("free_rooms_today", f"""
SELECT r.room_id, r.room_number, h.hotel_name, h.address_line AS location
FROM room r JOIN hotel h ON h.hotel_id = r.hotel_id
WHERE r.current_status = 'available' AND r.hotel_id = {POLICY_HOTEL} ORDER BY r.room_id LIMIT 200""")
def q_free_today(T):
    return reports.desk_free_rooms(T, POLICY_HOTEL)


@register("unavailable_list", f"""
SELECT room_id, count(*) AS n_blocks,
       string_agg(strftime(start_date, '%Y-%m-%d') || '/' || strftime(end_date, '%Y-%m-%d') || '/' || block_type || '/' || CAST(source_id AS VARCHAR), ','
                  ORDER BY start_date, end_date, block_type, source_id) AS ranges
FROM {BLOCKS_SQL} b WHERE b.end_date > DATE '{AS_OF}' GROUP BY room_id""")
def q_unavailable_list(T):
    """Every block of every room not ended yet, in order."""
    lists = search.unavailable_ranges(T, AS_OF, as_list=True)
    text = F.transform("ranges", lambda r: F.concat_ws(
        "/", r["start_date"].cast("string"), r["end_date"].cast("string"), r["block_type"], r["source_id"].cast("string")))
    return lists.select("room_id", F.size("ranges").cast("long").alias("n_blocks"), F.array_join(text, ",").alias("ranges"))


@register("open_days", f"""
SELECT r.room_id, CAST(d AS DATE) AS day FROM (
  SELECT room_id, unnest(generate_series(CAST(DATE '{AS_OF}' AS TIMESTAMP),
                                         CAST(DATE '{AS_OF}' + {HORIZON} AS TIMESTAMP), INTERVAL 1 DAY)) AS d
  FROM room) r
WHERE NOT EXISTS (SELECT 1 FROM {BLOCKS_SQL} b WHERE b.room_id = r.room_id
                  AND b.start_date <= CAST(r.d AS DATE) AND CAST(r.d AS DATE) < b.end_date)""")
def q_open_days(T):
    """J25 complement: free room-days of all rooms inside the horizon."""
    from innkeep.operators.bitmaps import days_of
    return days_of(_calendar(T), AS_OF, HORIZON + 1, occupied=False)


def _calendar(T):
    """Occupancy bitmaps of all rooms from the reference day on."""
    from innkeep.operators.bitmaps import for_all, occupancy
    return for_all(T["room"], occupancy(search.blocks(T, AS_OF), AS_OF, HORIZON + 1), HORIZON + 1)


@register("free_ranges", f"""
SELECT room_id, min(day) AS free_from, max(day) + 1 AS free_to FROM (
  SELECT room_id, day, day - CAST(row_number() OVER (PARTITION BY room_id ORDER BY day) AS INTEGER) AS run FROM (
    SELECT r.room_id, CAST(d AS DATE) AS day FROM (
      SELECT room_id, unnest(generate_series(CAST(DATE '{AS_OF}' AS TIMESTAMP),
                                             CAST(DATE '{AS_OF}' + {HORIZON} AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM room) r
    WHERE NOT EXISTS (SELECT 1 FROM {BLOCKS_SQL} b WHERE b.room_id = r.room_id
                      AND b.start_date <= CAST(r.d AS DATE) AND CAST(r.d AS DATE) < b.end_date)))
GROUP BY room_id, run""")
def q_free_ranges(T):
    """The stretches of open days of every room, read off its bitmap."""
    from innkeep.operators.bitmaps import free_ranges
    return free_ranges(_calendar(T), AS_OF, HORIZON + 1)


@register("renting_completion_archive", snap_sql(
    "renting", "(SELECT x.renting_id, x.room_id, x.customer_id, x.source_booking_id, x.start_date, x.end_date, "
    "'completed' AS status, x.status AS old_status FROM renting x "
    "WHERE x.renting_id IN (SELECT event_id * 10 + 1 FROM events WHERE event_type = 'purchase'))",
    "s.status IS DISTINCT FROM s.old_status AND s.renting_id NOT IN "
    "(SELECT source_renting_id FROM archive_bf WHERE record_type = 'renting')"))
def q_renting_completion(T):
    """Rentings completed from 'purchase' events (renting = first line of
    order event_id) and the archive rows that the completion produces."""
    ids = T["_raw"]["events"].filter(F.col("event_type") == "purchase") \
        .select((F.col("event_id") * 10 + 1).alias("renting_id"))
    changes = transitions.complete_rentings(T, ids)
    return arch.archive_transitions(T, changes, arch.archive_backfill(T), "renting")


# ---------------------------------------------------------------- sign-ups (J18 new customers; no SQL form)
def signup_requests(T) -> DataFrame:
    """Customer sign-ups from 'signup' events: SIN and e-mail from user_id
    (repeat sign-ups of a user clash), user name 'customer<user_id>' for
    every third user (clashes with existing accounts), phone from event_id."""
    ev = T["_raw"]["events"].filter(F.col("event_type") == "signup")
    u, e = F.col("user_id"), F.col("event_id")
    return ev.select(
        e.alias("request_id"), F.col("ts").alias("arrival"),
        F.lpad((F.lit(300000000) + u).cast("string"), 9, "0").alias("sin_raw"),
        F.lit("Guest").alias("first_name_raw"), F.concat(F.lit("User"), u.cast("string")).alias("last_name_raw"),
        F.concat(F.lit("user"), u.cast("string"), F.lit("@mail.example")).alias("email_raw"),
        F.lpad(e.cast("string"), 10, "5").alias("phone_raw"),
        F.concat(u.cast("string"), F.lit(" Queen Street")).alias("address_raw"),
        F.when(u % 3 == 0, F.concat(F.lit("customer"), u.cast("string")))
         .otherwise(F.concat(F.lit("user"), e.cast("string"))).alias("username_raw"))


@register("signup_customers", None)
def q_signup(T):
    from innkeep.plans.signup import register_customers
    return register_customers(T, signup_requests(T), AS_OF)


# ---------------------------------------------------------------- desk pages and desk requests
from innkeep.plans import desk  # noqa: E402

_PLACE = "JOIN room rm ON rm.room_id = b.room_id JOIN hotel h ON h.hotel_id = rm.hotel_id"


@register("booking_history", f"""
SELECT customer_id, position, booking_id, room_id, room_number, hotel_name, hotel_location, start_date, end_date, status, created_at,
       linked_renting_id, linked_renting_status
FROM (SELECT b.customer_id, b.booking_id, b.room_id, rm.room_number, h.hotel_name, h.address_line AS hotel_location, b.start_date,
        b.end_date, b.status, b.created_at, rt.renting_id AS linked_renting_id, rt.status AS linked_renting_status,
        row_number() OVER (PARTITION BY b.customer_id ORDER BY b.created_at DESC, b.booking_id DESC, coalesce(rt.renting_id, -1)) AS position
      FROM booking b {_PLACE} LEFT JOIN renting rt ON rt.source_booking_id = b.booking_id) WHERE position <= 300""")
def q_booking_history(T):
    return desk.booking_history(T)


@register("renting_history", f"""
SELECT customer_id, position, renting_id, source_booking_id, room_id, room_number, hotel_name, hotel_location, start_date, end_date, status, created_at
FROM (SELECT b.*, rm.room_number, h.hotel_name, h.address_line AS hotel_location,
        row_number() OVER (PARTITION BY b.customer_id ORDER BY b.created_at DESC, b.renting_id DESC) AS position
      FROM renting b {_PLACE}) WHERE position <= 300""")
def q_renting_history(T):
    return desk.renting_history(T)


@register("desk_bookings", f"""
SELECT b.booking_id, b.room_id, b.customer_id, p.legal_id AS customer_sin, b.start_date, b.end_date, b.status
FROM open_booking b JOIN room rm ON rm.room_id = b.room_id JOIN customer_t c ON c.customer_id = b.customer_id
JOIN person p ON p.legal_id = c.legal_id WHERE rm.hotel_id = {POLICY_HOTEL}
ORDER BY (b.end_date < DATE '{AS_OF}') DESC, b.start_date, b.booking_id DESC LIMIT 200""")
def q_desk_bookings(T):
    return desk.desk_bookings(T, POLICY_HOTEL, AS_OF)


@register("desk_rentings", f"""
SELECT b.renting_id, b.room_id, b.customer_id, p.legal_id AS customer_sin, b.employee_id, b.start_date, b.end_date, b.status
FROM active_renting b JOIN room rm ON rm.room_id = b.room_id JOIN customer_t c ON c.customer_id = b.customer_id
JOIN person p ON p.legal_id = c.legal_id WHERE rm.hotel_id = {POLICY_HOTEL} ORDER BY b.renting_id DESC LIMIT 200""")
def q_desk_rentings(T):
    return desk.desk_rentings(T, POLICY_HOTEL)


@register("desk_payments", f"""
SELECT y.payment_id, y.renting_id, y.employee_id, y.amount, y.method, y.paid_at, b.room_id, p.legal_id AS customer_sin
FROM payment y JOIN renting b ON b.renting_id = y.renting_id JOIN room rm ON rm.room_id = b.room_id
JOIN customer_t c ON c.customer_id = b.customer_id JOIN person p ON p.legal_id = c.legal_id WHERE rm.hotel_id = {POLICY_HOTEL}
ORDER BY y.payment_id DESC NULLS LAST, y.renting_id DESC, y.paid_at, y.amount, y.employee_id LIMIT 200""")
def q_desk_payments(T):
    return desk.desk_payments(T, POLICY_HOTEL)


@register("managers_report", """
SELECT e.employee_id AS manager_employee_id, hc.chain_name, h.hotel_name, p.last_name, p.first_name,
       row_number() OVER (ORDER BY hc.chain_name, h.hotel_name, p.last_name, p.first_name, e.employee_id) AS line
FROM employee e JOIN person p ON p.legal_id = e.legal_id JOIN hotel h ON h.hotel_id = e.hotel_id
JOIN hotel_chain hc ON hc.chain_id = h.chain_id WHERE e.is_manager""")
def q_managers_report(T):
    return desk.managers_in_order(reports.managers_register(T)).select(
        "manager_employee_id", "chain_name", "hotel_name", "last_name", "first_name", "line")


@register("account_lookup", """
SELECT q.username, a.account_id, a.role, a.is_active
FROM (SELECT DISTINCT 'Customer' || CAST(user_id AS VARCHAR) AS username FROM events
      UNION SELECT DISTINCT 'MANAGER' || CAST(user_id AS VARCHAR) FROM events) q
JOIN auth_account a ON lower(a.username) = lower(q.username)""")
def q_account_lookup(T):
    """Names typed by event users, in another case than stored."""
    u = T["_raw"]["events"].select(F.col("user_id").cast("string").alias("u"))
    return desk.find_accounts(T, u.select(F.explode(F.array(F.concat(F.lit("Customer"), "u"), F.concat(F.lit("MANAGER"), "u"))).alias("username")))


def staff_booking_requests(T) -> DataFrame:
    """Bookings asked for by desk staff, one per event: any room number up to
    a tenth past the last, guest by SIN, range of -1 to 5 nights."""
    n_rooms = T["_raw"]["part"].agg(F.expr("count(1) * 11 div 10")).scalar()
    n_staff = T["_raw"]["supplier"].agg(F.count(F.lit(1))).scalar()
    e, u = F.col("event_id"), F.col("user_id")
    start = F.date_add(F.col("ts").cast("date"), (e % 40).cast("int"))
    return T["_raw"]["events"].select(
        e.alias("request_id"), F.when(e % 3 == 0, "admin").otherwise("staff").alias("actor"), (e % n_staff).alias("actor_employee_id"),
        _lpad_id(200000000, u * 2).alias("customer_sin"), ((e * 7919) % n_rooms).alias("room_id"),
        start.alias("start_date"), F.date_add(start, (e % 7 - 1).cast("int")).alias("end_date"))


@register("intake_staff_bookings", f"""
SELECT q.request_id, q.room_id, c.customer_id, q.actor_employee_id AS created_by_employee_id, q.start_date, q.end_date,
       reason IS NULL AS qualified, reason
FROM (SELECT event_id AS request_id, CASE WHEN event_id % 3 = 0 THEN 'admin' ELSE 'staff' END AS actor,
        event_id % (SELECT count(*) FROM supplier) AS actor_employee_id, lpad(CAST(200000000 + user_id * 2 AS VARCHAR), 9, '0') AS customer_sin,
        (event_id * 7919) % (SELECT count(*) * 11 // 10 FROM part) AS room_id, CAST(ts AS DATE) + CAST(event_id % 40 AS INTEGER) AS start_date,
        CAST(ts AS DATE) + CAST(event_id % 40 + event_id % 7 - 1 AS INTEGER) AS end_date FROM events) q
LEFT JOIN room r ON r.room_id = q.room_id LEFT JOIN customer_t c ON c.legal_id = q.customer_sin
LEFT JOIN employee e ON e.employee_id = q.actor_employee_id,
LATERAL (SELECT CASE WHEN q.start_date < DATE '{INTAKE_AS_OF}' THEN 'start_in_past' WHEN q.end_date <= q.start_date THEN 'bad_range'
     WHEN r.hotel_id IS NULL THEN 'no_such_room' WHEN c.customer_id IS NULL THEN 'no_such_customer'
     WHEN q.actor <> 'admin' AND e.hotel_id IS DISTINCT FROM r.hotel_id THEN 'other_hotel'
     WHEN q.actor <> 'admin' AND c.hotel_id IS NOT NULL AND c.hotel_id <> e.hotel_id THEN 'customer_of_other_hotel' END AS reason) z""")
def q_staff_bookings(T):
    return desk.staff_bookings(T, staff_booking_requests(T), INTAKE_AS_OF)


def renting_from_booking_requests(T) -> DataFrame:
    """One request per order (some twice, some for no booking) by an employee or an administrator."""
    n_staff = T["_raw"]["supplier"].agg(F.count(F.lit(1))).scalar()
    k = F.col("o_orderkey")
    o = T["_raw"]["orders"].select(k.alias("k"), F.explode(F.sequence(F.lit(0), F.when(k % 2 == 0, 1).otherwise(0))).alias("i"))
    k = F.col("k")
    return o.select((k * 2 + F.col("i")).alias("request_id"), (-F.col("i")).alias("arrival"), F.when(k % 11 == 0, -k).otherwise(k).alias("booking_id"),
                    F.when(k % 4 == 0, "staff").otherwise("admin").alias("actor"), F.when(k % 13 == 0, F.lit(None)).otherwise(k % n_staff).alias("employee_id"))


@register("renting_requests_from_bookings", f"""
SELECT request_id, booking_id, employee_id, room_id, customer_id, start_date, end_date,
       coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY booking_id, reason ORDER BY arrival, request_id) > 1 THEN 'not_checked_in' END) IS NULL AS accepted,
       coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY booking_id, reason ORDER BY arrival, request_id) > 1 THEN 'not_checked_in' END) AS reason
FROM (SELECT n.*, coalesce(pre, CASE WHEN {_rule_exists('room_id', 'renting')} THEN 'room_renting'
        WHEN {_rule_exists('room_id', 'booking')} THEN 'room_booking' WHEN {_rule_exists('customer_id', 'renting')} THEN 'customer_renting'
        WHEN {_rule_exists('customer_id', 'booking')} THEN 'customer_booking' END) AS reason
      FROM (SELECT q.*, b.room_id, b.customer_id, b.start_date, b.end_date, -1 AS renting_id, q.booking_id AS source_booking_id,
              CASE WHEN e.employee_id IS NULL THEN 'no_employee' WHEN b.room_id IS NULL THEN 'no_such_booking'
                WHEN b.status <> 'checked_in' THEN 'not_checked_in'
                WHEN q.actor <> 'admin' AND e.hotel_id IS DISTINCT FROM r.hotel_id THEN 'other_hotel'
                WHEN b.start_date > DATE '{AS_OF}' OR b.end_date <= DATE '{AS_OF}' THEN 'outside_stay' END AS pre
            FROM (SELECT o_orderkey * 2 + i AS request_id, -i AS arrival, CASE WHEN o_orderkey % 11 = 0 THEN -o_orderkey ELSE o_orderkey END AS booking_id,
                    CASE WHEN o_orderkey % 4 = 0 THEN 'staff' ELSE 'admin' END AS actor,
                    CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % (SELECT count(*) FROM supplier) END AS employee_id
                  FROM (SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 2 = 0 THEN [0, 1] ELSE [0] END) AS i FROM orders)) q
            LEFT JOIN booking b ON b.booking_id = q.booking_id LEFT JOIN room r ON r.room_id = b.room_id
            LEFT JOIN employee e ON e.employee_id = q.employee_id) n)""")
def q_rentings_from_bookings(T):
    return desk.rentings_from_bookings(T, renting_from_booking_requests(T), AS_OF)


@register("local_days", """
SELECT event_id, CAST(timezone('America/Toronto', timezone('UTC', ts)) AS DATE) AS local_day FROM events""")
def q_local_days(T):
    """The calendar day of each event at the hotel office."""
    from innkeep.functions.columns import toronto_today
    return T["_raw"]["events"].select("event_id", toronto_today("ts").alias("local_day"))

"""DuckDB SQL for the correctness gate.

``BINDINGS`` repeats, in DuckDB SQL, the driver -> domain projections of
``innkeep.sources.bindings``; ``with_tables(body)`` prefixes a query with
the CTEs it mentions.  The driver tables are pre-registered views.
"""

from __future__ import annotations

import re

BINDINGS: dict[str, str] = {
    "hotel_chain": """SELECT CAST(r_regionkey AS BIGINT) AS chain_id, r_name AS chain_name
        FROM region""",
    "hotel": """SELECT CAST(n_nationkey AS BIGINT) AS hotel_id, CAST(n_regionkey AS BIGINT) AS chain_id,
        n_name AS hotel_name, CAST(n_nationkey % 5 + 1 AS SMALLINT) AS category,
        CAST(24 + n_nationkey % 14 AS INTEGER) AS total_rooms,
        CASE WHEN n_nationkey % 7 = 0 THEN n_name
             ELSE n_name || ' Street,  CITY_' || CAST(n_nationkey % 10 AS VARCHAR) || ' , X' END AS address_line,
        COALESCE(NULLIF(trim(split_part(CASE WHEN n_nationkey % 7 = 0 THEN n_name
             ELSE n_name || ' Street,  CITY_' || CAST(n_nationkey % 10 AS VARCHAR) || ' , X' END, ',', 2), ' '), ''),
             CASE WHEN n_nationkey % 7 = 0 THEN n_name
             ELSE n_name || ' Street,  CITY_' || CAST(n_nationkey % 10 AS VARCHAR) || ' , X' END) AS area
        FROM nation""",
    "room": """SELECT p_partkey AS room_id, p_partkey % 25 AS hotel_id,
        CAST(p_partkey // 25 + 100 AS VARCHAR) AS room_number,
        CASE split_part(p_type, ' ', 1) WHEN 'ECONOMY' THEN 'single' WHEN 'STANDARD' THEN 'double'
             WHEN 'LARGE' THEN 'suite' WHEN 'PROMO' THEN 'family' WHEN 'SMALL' THEN 'double'
             ELSE 'other' END AS capacity,
        CAST(p_retailprice AS DECIMAL(10,2)) AS base_price,
        CASE WHEN p_size % 9 = 0 THEN p_name WHEN p_size % 9 = 1 THEN '  ' END AS issues,
        CASE WHEN p_size = 13 THEN 'maintenance' ELSE 'available' END AS current_status
        FROM part""",
    "customer_t": """SELECT c_custkey AS customer_id,
        lpad(CAST(200000000 + c_custkey AS VARCHAR), 9, '0') AS legal_id,
        CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END AS hotel_id,
        DATE '1995-01-01' + CAST(c_custkey % 2000 AS INTEGER) AS registration_date,
        c_mktsegment
        FROM customer""",
    "person": """SELECT lpad(CAST(200000000 + c_custkey AS VARCHAR), 9, '0') AS legal_id, 'SIN' AS id_type,
            split_part(c_name, '#', 1) AS first_name, split_part(c_name, '#', 2) AS last_name,
            'customer' || CAST(c_custkey AS VARCHAR) || '@mail.example' AS email,
            lpad(CAST(c_custkey AS VARCHAR), 10, '9') AS phone
        FROM customer
        UNION ALL
        SELECT lpad(CAST(700000000 + s_suppkey AS VARCHAR), 9, '0'), 'SIN',
            split_part(s_name, '#', 1), split_part(s_name, '#', 2),
            'staff' || CAST(s_suppkey AS VARCHAR) || '@hotel.example',
            lpad(CAST(s_suppkey AS VARCHAR), 10, '8')
        FROM supplier""",
    "person_raw": """SELECT CASE WHEN c_custkey % 11 = 0 THEN 'X' || CAST(c_custkey AS VARCHAR)
                 WHEN c_custkey % 13 = 0 THEN lpad(CAST(200000000 + c_custkey - 1 AS VARCHAR), 9, '0')
                 ELSE lpad(CAST(200000000 + c_custkey AS VARCHAR), 9, '0') END AS legal_id,
            'SIN' AS id_type, split_part(c_name, '#', 1) AS first_name,
            split_part(c_name, '#', 2) AS last_name,
            'customer' || CAST(c_custkey AS VARCHAR) || '@mail.example' AS email
        FROM customer
        UNION ALL
        SELECT lpad(CAST(700000000 + s_suppkey AS VARCHAR), 9, '0'), 'SIN',
            split_part(s_name, '#', 1), split_part(s_name, '#', 2),
            'staff' || CAST(s_suppkey AS VARCHAR) || '@hotel.example'
        FROM supplier""",
    "employee": """SELECT s_suppkey AS employee_id,
        lpad(CAST(700000000 + s_suppkey AS VARCHAR), 9, '0') AS legal_id,
        CAST(s_nationkey AS BIGINT) AS hotel_id,
        CASE s_suppkey % 3 WHEN 0 THEN 'Manager' WHEN 1 THEN 'Receptionist' ELSE 'Concierge' END AS role_title,
        DATE '1990-01-01' + CAST((s_suppkey * 37) % 3000 AS INTEGER) AS hired_on,
        s_suppkey % 3 = 0 AS is_manager
        FROM supplier""",
    "auth_account": """SELECT s_suppkey * 2 AS account_id,
            CASE WHEN s_suppkey % 3 = 0 THEN 'manager' ELSE 'employee' END AS role,
            CASE WHEN s_suppkey % 3 = 0 THEN 'manager' ELSE 'employee' END || CAST(s_suppkey AS VARCHAR) AS username,
            s_suppkey AS employee_id, CAST(NULL AS BIGINT) AS customer_id, s_suppkey % 10 <> 3 AS is_active
        FROM supplier WHERE s_suppkey % 7 <> 0
        UNION ALL
        SELECT c_custkey * 2 + 1, 'customer', 'customer' || CAST(c_custkey AS VARCHAR),
            CAST(NULL AS BIGINT), c_custkey, c_custkey % 10 <> 3
        FROM customer WHERE c_custkey % 7 <> 0""",
    "booking": """SELECT o_orderkey AS booking_id, po.room_id, o_custkey AS customer_id,
        po.created_by_employee_id, CAST(o_orderdate AS DATE) AS start_date,
        CAST(o_orderdate AS DATE) + po.nights AS end_date,
        CASE WHEN o_orderstatus = 'O' THEN 'reserved' WHEN o_orderstatus = 'P' THEN 'checked_in'
             WHEN o_orderstatus = 'F' AND o_orderpriority < '3' THEN 'cancelled'
             WHEN o_orderstatus = 'F' THEN 'completed' END AS status,
        o_orderdate AS created_at
        FROM orders JOIN (SELECT l_orderkey, min(l_partkey) AS room_id,
                                 CAST(max(l_quantity) AS INTEGER) AS nights,
                                 min(l_suppkey) AS created_by_employee_id
                          FROM lineitem GROUP BY l_orderkey) po ON o_orderkey = po.l_orderkey""",
    "renting": """SELECT pl.l_orderkey * 10 + pl.l_linenumber AS renting_id, pl.room_id,
        o_custkey AS customer_id, pl.employee_id,
        CASE WHEN pl.l_linenumber = 1 THEN pl.l_orderkey END AS source_booking_id,
        CAST(pl.first_ship AS DATE) AS start_date, CAST(pl.first_ship AS DATE) + pl.nights AS end_date,
        CASE pl.flag WHEN 'N' THEN 'active' WHEN 'R' THEN 'completed' WHEN 'A' THEN 'cancelled' END AS status,
        pl.first_ship AS created_at
        FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS room_id, min(l_suppkey) AS employee_id,
                     min(l_shipdate) AS first_ship, CAST(max(l_quantity) AS INTEGER) AS nights,
                     min(l_returnflag) AS flag
              FROM lineitem GROUP BY l_orderkey, l_linenumber) pl
        JOIN orders ON o_orderkey = pl.l_orderkey""",
    "payment": """SELECT CAST(NULL AS BIGINT) AS payment_id, l_orderkey * 10 + l_linenumber AS renting_id, l_suppkey AS employee_id,
        CAST(l_extendedprice AS DECIMAL(12,2)) AS amount,
        CASE l_orderkey % 4 WHEN 0 THEN 'cash' WHEN 1 THEN 'credit' WHEN 2 THEN 'debit' ELSE 'online' END AS method,
        l_shipdate AS paid_at
        FROM lineitem""",
    "open_booking": "SELECT * FROM booking WHERE status IN ('reserved', 'checked_in')",
    "active_renting": "SELECT * FROM renting WHERE status = 'active'",
}

_SIN = re.compile(r"lpad\(CAST\(([27])00000000 \+ (\w+)( - 1)? AS VARCHAR\), 9, '0'\)")


def wide_ids(sql: str) -> str:
    """Legal ids past a hundred million keys: leading digit and the key in 18 digits."""
    return _SIN.sub(lambda m: f"(CASE WHEN {m[2]}{m[3] or ''} < 100000000 THEN {m[0]} ELSE "
                              f"'{m[1]}' || lpad(CAST({m[2]}{m[3] or ''} AS VARCHAR), 18, '0') END)", sql)


BINDINGS = {name: wide_ids(sql) for name, sql in BINDINGS.items()}

# CTEs that read other CTEs (listed after their inputs).
_DEPS = {"open_booking": ["booking"], "active_renting": ["renting"]}
_ORDER = list(BINDINGS)


def with_tables(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the binding CTEs it (transitively) mentions."""
    ctes = dict(BINDINGS)
    order = list(_ORDER)
    if extra:
        ctes.update(extra)
        order += [k for k in extra if k not in order]
    needed: set[str] = set()

    def visit(text: str):
        for name in order:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                for d in _DEPS.get(name, []):
                    if d not in needed:
                        needed.add(d)
                        visit(ctes[d])
                visit(ctes[name])

    visit(body)
    parts = [f"{n} AS ({ctes[n]})" for n in order if n in needed]
    with_ = "WITH RECURSIVE " if any(re.search(rf"\b{n}\b", ctes[n]) and "UNION ALL" in ctes[n] for n in needed) else "WITH "
    return (with_ + ",\n".join(parts) + "\n" + body) if parts else body

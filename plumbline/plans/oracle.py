"""SQL for the engine's own queries, over the same tables."""

LINEAGE_EDGES = """
SELECT 'e:r:p' || l_partkey || ':o' || l_orderkey AS id, 'reads_dataset' AS type, 'dataset:part.' || l_partkey AS src, 'step:o' || l_orderkey AS dst, max(l_returnflag) AS flag
  FROM lineitem GROUP BY l_partkey, l_orderkey
UNION ALL SELECT 'e:w:o' || o_orderkey, 'writes_dataset', 'step:o' || o_orderkey, 'dataset:order.' || o_orderkey, 'N' FROM orders
UNION ALL SELECT 'e:r:o' || o_orderkey, 'reads_dataset', 'dataset:order.' || o_orderkey, 'sqlstatement:c' || o_custkey, 'N' FROM orders
UNION ALL SELECT 'e:w:c' || c_custkey, 'writes_dataset', 'sqlstatement:c' || c_custkey, 'dataset:customer.' || c_custkey, 'N' FROM customer
UNION ALL SELECT 'e:r:c' || c_custkey, 'reads_dataset', 'dataset:customer.' || c_custkey, 'step:n' || c_nationkey, 'N' FROM customer
UNION ALL SELECT 'e:w:n' || n_nationkey, 'writes_dataset', 'step:n' || n_nationkey, 'dataset:nation.' || n_nationkey, 'N' FROM nation
UNION ALL SELECT 'e:r:n' || n_nationkey, 'reads_dataset', 'dataset:nation.' || n_nationkey, 'step:r' || n_regionkey, 'N' FROM nation
UNION ALL SELECT 'e:w:r' || r_regionkey, 'writes_dataset', 'step:r' || r_regionkey, 'dataset:region.' || r_regionkey, 'N' FROM region
"""

LINEAGE_NODES = """
SELECT 'dataset:part.' || p_partkey AS id, 'Dataset' AS type, p_name AS label FROM part
UNION ALL SELECT 'step:o' || o_orderkey, 'Step', 'order step ' || o_orderkey FROM orders
UNION ALL SELECT 'dataset:order.' || o_orderkey, 'Dataset', 'order.' || o_orderkey FROM orders
UNION ALL SELECT 'sqlstatement:c' || c_custkey, 'SqlStatement', 'customer statement ' || c_custkey FROM customer
UNION ALL SELECT 'dataset:customer.' || c_custkey, 'Dataset', c_name FROM customer
UNION ALL SELECT 'step:n' || n_nationkey, 'Step', 'nation step ' || n_nationkey FROM nation
UNION ALL SELECT 'dataset:nation.' || n_nationkey, 'Dataset', n_name FROM nation
UNION ALL SELECT 'step:r' || r_regionkey, 'Step', 'region step ' || r_regionkey FROM region
UNION ALL SELECT 'dataset:region.' || r_regionkey, 'Dataset', r_name FROM region
"""

VARIABLE_EDGES = """
SELECT 'e:rv:' || event_id AS id, 'reads_variable' AS type, 'variable:events.u' || user_id || '.' || event_type AS src, 'step:e' || event_id AS dst, event_type AS value FROM events
UNION ALL SELECT 'e:wv:' || event_id, 'writes_variable', 'step:e' || event_id, 'variable:events.u' || user_id || '.' || nt, nt
  FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nt FROM events) WHERE nt IS NOT NULL
"""

E = f"edges AS ({LINEAGE_EDGES})"
N = f"nodes AS ({LINEAGE_NODES})"
V = f"edges AS ({VARIABLE_EDGES})"


def reached(start: str, here: str, there: str, hops: int) -> str:
    """CTE reached(node, hop): nodes by their least hop."""
    return f"""walk(node, hop) AS (
  SELECT '{start}', 0
  UNION SELECT e.{there}, w.hop + 1 FROM walk w JOIN edges e ON e.{here} = w.node WHERE w.hop < {hops}
), reached AS (SELECT node, min(hop) AS hop FROM walk GROUP BY node)"""


def trace(start: str, direction: str, hops: int) -> str:
    here, there = ("dst", "src") if direction == "upstream" else ("src", "dst")
    return f"WITH RECURSIVE {E}, {reached(start, here, there, hops)} SELECT node AS id, '{direction}' AS direction, hop FROM reached WHERE hop > 0"


def trace_edges(start: str, direction: str, hops: int) -> str:
    """Walked edges; all but the one that discovers a node, the least id of its level, are cycles."""
    here, there = ("dst", "src") if direction == "upstream" else ("src", "dst")
    return f"""WITH RECURSIVE {E}, {reached(start, here, there, hops)},
seen AS (SELECT e.id, e.src, e.dst, a.hop AS lvl, b.hop AS found, min(e.id) OVER (PARTITION BY e.{there}, a.hop) AS least
  FROM edges e JOIN reached a ON e.{here} = a.node JOIN reached b ON e.{there} = b.node)
SELECT id, src, dst, NOT (found = lvl + 1 AND id = least) AS cycle FROM seen"""


def variables(start: str, depth: int) -> str:
    return f"""WITH RECURSIVE {V}, walk(v, d) AS (
  SELECT '{start}', 0
  UNION SELECT w2.dst, w.d + 1 FROM walk w JOIN edges r ON r.src = w.v AND r.type = 'reads_variable' JOIN edges w2 ON w2.src = r.dst AND w2.type = 'writes_variable' WHERE w.d < {depth}
), vars AS (SELECT v, min(d) AS d FROM walk GROUP BY v)"""

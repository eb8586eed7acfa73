"""Three small sources, from CSV files to profiles, against an answer worked out by hand."""

from __future__ import annotations

import pytest

from kinfold.plans.resolution import CLUSTERS, EDGES, GOLDEN, MEMBERS, run
from kinfold.model import RunConfig
from kinfold.sources.metadata import from_csv
from kinfold.sources.state import StateStore

#: The seed data set, file by file.
SEEDS = {
    "source_table": """table_id,table_fqn,entity_key_expr,watermark_column,is_active
crm,sample_crm_customers,customer_id,updated_at,true
orders,sample_orders,order_id,order_date,true
pos,sample_pos_transactions,transaction_id,transaction_date,true
""",
    "rule": """rule_id,identifier_type,priority,is_active,canonicalize,max_group_size
email_exact,EMAIL,1,true,LOWERCASE,100
phone_exact,PHONE,2,true,NONE,100
loyalty_exact,LOYALTY,3,true,NONE,10
""",
    "identifier_mapping": """table_id,identifier_type,identifier_value_expr,is_hashed
crm,EMAIL,email,false
crm,PHONE,phone,false
orders,EMAIL,customer_email,false
orders,PHONE,contact_phone,false
pos,LOYALTY,loyalty_card_id,false
pos,PHONE,contact_phone,false
""",
    "identifier_exclusion": """identifier_type,identifier_value_pattern,match_type,reason
EMAIL,test@%,LIKE,Test emails
PHONE,0000000000,EXACT,Invalid phone
""",
    "entity_attribute_mapping": """table_id,attribute_name,attribute_expr
crm,email,email
crm,phone,phone
crm,first_name,first_name
crm,last_name,last_name
crm,record_updated_at,updated_at
orders,email,customer_email
orders,phone,contact_phone
orders,record_updated_at,order_date
pos,phone,contact_phone
pos,record_updated_at,transaction_date
""",
    "survivorship_rule": """attribute_name,strategy,source_priority_list,recency_field
email,MOST_RECENT,,record_updated_at
phone,MOST_RECENT,,record_updated_at
first_name,MOST_RECENT,,record_updated_at
last_name,MOST_RECENT,,record_updated_at
""",
    "crm": """customer_id,email,phone,first_name,last_name,loyalty_id,updated_at
1,alice@example.com,5551234567,Alice,Smith,,2024-01-01 10:00:00
2,bob@example.com,5559876543,Bob,Jones,,2024-01-02 11:00:00
3,charlie@example.com,,Charlie,Brown,,2024-01-03 12:00:00
4,alice@example.com,5551111111,Alice,Smith-Johnson,,2024-01-04 13:00:00
5,david@example.com,5552222222,David,Wilson,,2024-01-05 14:00:00
6,,5551234567,A,Smith,,2024-01-06 15:00:00
7,eve@example.com,5553333333,Eve,Davis,,2024-01-07 16:00:00
8,frank@example.com,,Frank,Miller,,2024-01-08 17:00:00
9,bob@example.com,,Robert,Jones,,2024-01-09 18:00:00
10,grace@example.com,5554444444,Grace,Taylor,,2024-01-10 19:00:00
""",
    "orders": """order_id,customer_email,contact_phone,order_date
101,alice@example.com,,2024-01-15
102,bob@example.com,5559876543,2024-01-16
103,newcustomer@example.com,5555555555,2024-01-17
104,charlie@example.com,5556666666,2024-01-18
105,david@example.com,,2024-01-19
106,alice@example.com,,2024-01-20
107,eve@example.com,,2024-01-21
108,frank@example.com,5557777777,2024-01-22
109,,5554444444,2024-01-23
110,grace@example.com,,2024-01-24
""",
    "pos": """transaction_id,loyalty_card_id,contact_phone,transaction_date
1001,LOYAL001,5551234567,2024-01-25
1002,LOYAL002,5559876543,2024-01-26
1003,LOYAL003,,2024-01-27
1004,LOYAL001,,2024-01-28
1005,LOYAL004,5552222222,2024-01-29
1006,,5553333333,2024-01-30
1007,LOYAL005,5558888888,2024-01-31
1008,LOYAL002,,2024-02-01
1009,LOYAL006,5554444444,2024-02-02
1010,,5551111111,2024-02-03
""",
}
#: The answer: cluster, size, types, confidence, members; email, phone, first and last name.
CLUSTERED = [
    ("crm:1", 8, 3, 1.0, "crm:1 crm:4 crm:6 orders:101 orders:106 pos:1001 pos:1004 pos:1010", "alice@example.com", "5551111111", "A", "Smith"),
    ("crm:2", 5, 3, 1.0, "crm:2 crm:9 orders:102 pos:1002 pos:1008", "bob@example.com", "5559876543", "Robert", "Jones"),
    ("crm:10", 4, 2, 0.833, "crm:10 orders:109 orders:110 pos:1009", "grace@example.com", "5554444444", "Grace", "Taylor"),
    ("crm:5", 3, 2, 0.833, "crm:5 orders:105 pos:1005", "david@example.com", "5552222222", "David", "Wilson"),
    ("crm:7", 3, 2, 0.833, "crm:7 orders:107 pos:1006", "eve@example.com", "5553333333", "Eve", "Davis"),
    ("crm:3", 2, 1, 0.667, "crm:3 orders:104", "charlie@example.com", "5556666666", "Charlie", "Brown"),
    ("crm:8", 2, 1, 0.667, "crm:8 orders:108", "frank@example.com", "5557777777", "Frank", "Miller"),
    ("orders:103", 1, 0, 1.0, "orders:103", "newcustomer@example.com", "5555555555", None, None),
    ("pos:1003", 1, 0, 1.0, "pos:1003", None, None, None, None),
    ("pos:1007", 1, 0, 1.0, "pos:1007", None, "5558888888", None, None),
]


@pytest.fixture
def seeds(spark, tmp_path):
    for name, text in SEEDS.items():
        (tmp_path / f"{name}.csv").write_text(text)
    path = {name: f"{tmp_path}/{name}.csv" for name in SEEDS}
    frames = {x: spark.read.option("header", True).csv(path[x]) for x in ("crm", "orders", "pos")}
    return from_csv(spark, {k: v for k, v in path.items() if k not in frames}), frames, StateStore(spark, f"{tmp_path.as_uri()}/state")


@pytest.mark.parametrize("algorithm", ["hash_min", "alternating"])
def test_seeds_resolve_to_the_answer(seeds, algorithm):
    meta, frames, store = seeds
    r = run(store.spark, meta, frames, store, RunConfig(algorithm=algorithm))
    assert (r.counts["entities"], r.counts["edges"], r.counts["skipped"], r.counts["excluded"]) == (30, 21, 0, 0)
    if algorithm == "hash_min":
        assert r.lp_iterations == 3
    assert store.read("stage_metrics").where("stage_name = 'identifier_extraction'").first()["rows_out"] == 45
    members: dict[str, list[str]] = {}
    for m in store.read(MEMBERS).collect():
        members.setdefault(m["resolved_id"], []).append(m["entity_key"])
    assert {k: " ".join(sorted(v)) for k, v in members.items()} == {c[0]: c[4] for c in CLUSTERED}
    got = store.read(CLUSTERS).join(store.read(GOLDEN).drop("updated_ts"), "resolved_id").collect()
    row = lambda x: (x["resolved_id"], x["cluster_size"], x["edge_diversity"], x["confidence_score"], x["email_primary"], x["phone_primary"], x["first_name_primary"], x["last_name_primary"])
    assert sorted(map(row, got)) == sorted((*c[:4], *c[5:]) for c in CLUSTERED)
    assert store.read(EDGES).count() == 21


def test_seeds_in_two_runs_give_the_same(seeds):
    """Orders and transactions of the second half come later; the marks of the first run say which rows are new."""
    meta, frames, store = seeds
    early = {"crm": frames["crm"], "orders": frames["orders"].where("order_date < '2024-01-20'"), "pos": frames["pos"].where("transaction_date < '2024-01-30'")}
    run(store.spark, meta, early, store)
    second = run(store.spark, meta, frames, store, RunConfig(mode="INCR"))
    assert second.counts["entities"] < 30
    got: dict[str, list[str]] = {}
    for m in store.read(MEMBERS).collect():
        got.setdefault(m["resolved_id"], []).append(m["entity_key"])
    assert {k: " ".join(sorted(v)) for k, v in got.items()} == {c[0]: c[4] for c in CLUSTERED}
    assert {r["resolved_id"]: r["cluster_size"] for r in store.read(CLUSTERS).collect()} == {c[0]: c[1] for c in CLUSTERED}

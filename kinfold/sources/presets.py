"""Ready-made rules, mappings and exclusions for common kinds of data, to start from."""

from __future__ import annotations

from ..model import Exclusion, Mapping, Metadata, Rule, Source

COMMON = (Exclusion("EMAIL", "test@%", "LIKE", "test address"), Exclusion("EMAIL", "noreply@%", "LIKE", "role address"), Exclusion("PHONE", "0000000000", "EXACT", "placeholder"))


def retail() -> Metadata:
    return Metadata(
        (Source("crm", "crm.customers", "customer_id", "updated_at", trust_rank=1), Source("shop", "shop.orders", "order_id", "order_ts", 60, trust_rank=2), Source("pos", "pos.transactions", "transaction_id", "transaction_ts", trust_rank=3)),
        (Rule("r_email", "EMAIL", "LOWERCASE"), Rule("r_phone", "PHONE", "PHONE_DIGITS", 1000), Rule("r_loyalty", "LOYALTY", "UPPERCASE", 100)),
        (Mapping("crm", "EMAIL", "email"), Mapping("crm", "PHONE", "phone"), Mapping("crm", "LOYALTY", "loyalty_id"), Mapping("shop", "EMAIL", "customer_email"), Mapping("pos", "LOYALTY", "loyalty_card_id"), Mapping("pos", "PHONE", "contact_phone")),
        COMMON,
    )


def healthcare() -> Metadata:
    person = "concat_ws('|', lower(last_name), lower(first_name), cast(birth_date AS string))"
    return Metadata(
        (Source("ehr", "ehr.patients", "patient_id", "updated_at", trust_rank=1), Source("claims", "claims.members", "member_id", "updated_at", trust_rank=2)),
        (Rule("r_mrn", "MRN", max_group_size=10), Rule("r_person", "NAME_DOB", max_group_size=20), Rule("r_ssn4", "SSN4_DOB", max_group_size=20)),
        (Mapping("ehr", "MRN", "mrn"), Mapping("ehr", "NAME_DOB", person), Mapping("claims", "NAME_DOB", person), Mapping("ehr", "SSN4_DOB", "concat_ws('|', right(ssn, 4), cast(birth_date AS string))"), Mapping("claims", "SSN4_DOB", "concat_ws('|', right(ssn, 4), cast(birth_date AS string))")),
    )


def financial() -> Metadata:
    return Metadata(
        (Source("core", "core.accounts", "account_id", "updated_at", trust_rank=1), Source("cards", "cards.holders", "holder_id", "updated_at", trust_rank=2)),
        (Rule("r_tax", "TAX_ID", "PHONE_DIGITS", 50), Rule("r_email", "EMAIL", "LOWERCASE", 1000), Rule("r_phone", "PHONE", "PHONE_DIGITS", 1000)),
        tuple(Mapping(s, k, c) for s in ("core", "cards") for k, c in (("TAX_ID", "tax_id"), ("EMAIL", "email"), ("PHONE", "phone"))),
        COMMON,
    )


def b2b() -> Metadata:
    return Metadata(
        (Source("crm", "crm.accounts", "account_id", "updated_at", entity_type="COMPANY", trust_rank=1), Source("app", "app.workspaces", "workspace_id", "updated_at", entity_type="COMPANY", trust_rank=2)),
        (Rule("r_domain", "DOMAIN", "LOWERCASE", 500), Rule("r_duns", "DUNS", max_group_size=100)),
        (Mapping("crm", "DOMAIN", "domain"), Mapping("app", "DOMAIN", "split_part(owner_email, '@', 2)"), Mapping("crm", "DUNS", "duns")),
        tuple(Exclusion("DOMAIN", d, "EXACT", "public mail") for d in ("gmail.com", "outlook.com", "yahoo.com")),
    )


PRESETS = {"retail": retail, "healthcare": healthcare, "financial": financial, "b2b": b2b}

from crossbasket.functions.contact import cleanse_phone, normalise_email
from crossbasket.functions.dates import (
    card_date_sentinel,
    order_date_format,
    tenure_group,
    tenure_years,
)
from crossbasket.functions.text import category_default, labelled, transaction_key, trim_all
from crossbasket.functions.tiers import display_rank, tier_whitelist, update_tier

__all__ = [
    "card_date_sentinel",
    "category_default",
    "cleanse_phone",
    "display_rank",
    "labelled",
    "normalise_email",
    "order_date_format",
    "tenure_group",
    "tenure_years",
    "tier_whitelist",
    "transaction_key",
    "trim_all",
    "update_tier",
]

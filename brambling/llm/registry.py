"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from . import chat, decontaminate, licenses, media, mixing, near_duplicates, secrets, token_store, toxicity, urls

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_token_store": token_store.op2_token_store,
    "op3_poisson_mix": mixing.op3_poisson_mix,
    "op4_media_columns": media.op4_media_columns,
    "op5_url_filter": urls.op5_url_filter,
    "op6_near_duplicates": near_duplicates.op6_near_duplicates,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_chat_rotation": chat.op9_chat_rotation,
    "op10_decontamination": decontaminate.op10_decontamination,
}
ORACLE: dict[str, str] = {**mixing.ORACLE, **urls.ORACLE, **chat.ORACLE, **decontaminate.ORACLE}

"""Declared schemas, as DDL text. Nothing is inferred when reading."""

DOCUMENTS = "array<struct<type:string,value:string>>"
RISK = (
    "struct<program:string,pep_tier:int,media_confidence:double,articles:array<struct<headline:string,source:string>>>"
)
ENTRY = (
    "struct<entry_id:string,provider_id:string,list_type:string,list_version:string,entity_name:string,"
    f"aliases:array<string>,dob_iso:string,country_iso2:string,risk_payload:{RISK}>"
)
KYC_PAYLOAD = (
    f"struct<full_name:string,dob:string,nationality:string,residence_country:string,document_ids:{DOCUMENTS}>"
)
MATCH_ITEM = (
    "struct<match_id:string,provider_id:string,list_type:string,matched_name:string,score:double,dob_match:boolean,"
    "evidence_ref:string,pep_tier:int,media_confidence:double>"
)

# --- files ---
KYC_SUBMISSION = (
    "client_id string, trace_id string, full_name string, dob string, nationality string, residence_country string, "
    f"document_ids {DOCUMENTS}, _meta struct<category:string,expected_match_entry_id:string>"
)
WATCHLIST = (
    "entry_id string, provider_id string, list_type string, list_version string, entity_name string, "
    f"aliases array<string>, dob_iso string, country_iso2 string, risk_payload {RISK}"
)
WATCHLIST_UPDATE = (
    f"provider_id string, list_type string, change string, entry {ENTRY}, target_profile {KYC_PAYLOAD}, "
    "target_client_id string, new_list_version string, expected_outcome_after string"
)
MANIFEST = (
    "seed int, list_version string, providers map<string,struct<list_type:string,list_version:string,count:int,"
    "file:string,sha256:string>>, plant_targets array<string>"
)
GOLDEN_NORMALIZATION = (
    f"input {KYC_PAYLOAD}, expected struct<canonical_name:string,name_parts:struct<first:string,last:string,"
    "middle:string>,dob_iso:string,nationality_iso2:string,residence_iso2:string,profile_hash:string>"
)
GOLDEN_MATCHING = (
    "profile_name string, candidate_name string, dob_profile string, dob_candidate string, list_type string, "
    "expected_match boolean, min_score double, _corrupt_record string"
)
GOLDEN_DECISIONS = (
    "matches array<struct<list_type:string,score:double,pep_tier:int,media_confidence:double>>, "
    "expected struct<outcome:string,reason_codes:array<string>>"
)

# --- events ---
ENVELOPE = (
    "trace_id string, client_id string, event_type string, schema_version int, produced_at timestamp, "
    "producer string, payload string, _corrupt_record string"
)
MESSAGE = (
    "topic string, partition int, offset bigint, key string, value string, timestamp timestamp"
)
UPDATE_PAYLOAD = (
    f"provider_id string, list_type string, change string, entry {ENTRY}, new_list_version string"
)

# --- stored tables ---
RAW_PROFILE = (
    f"id string, client_id string, trace_id string, raw_payload {KYC_PAYLOAD}, raw_json string, source string, "
    "created_at timestamp"
)
NORMALIZED_PROFILE = (
    "id string, client_id string, trace_id string, profile_hash string, canonical_name string, "
    "name_parts struct<first:string,last:string,middle:string>, dob_iso date, nationality_iso2 string, "
    f"residence_iso2 string, document_ids {DOCUMENTS}, message_key string, created_at timestamp"
)
WATCHLIST_ENTRY = (
    "id string, provider_id string, list_type string, list_version string, entity_name string, "
    f"aliases array<string>, dob_iso date, country_iso2 string, risk_payload {RISK}, is_active boolean, "
    "created_at timestamp"
)
SCREENING = (
    "screening_id string, client_id string, trace_id string, profile_hash string, list_versions map<string,string>, "
    "status string, providers_queried int, candidates bigint, matches bigint, max_score double, cache_hits int, "
    "degraded_providers array<string>, screened_at timestamp"
)
MATCH = (
    "match_id string, screening_id string, client_id string, provider_id string, list_type string, "
    "matched_name string, score decimal(5,4), dob_match boolean, evidence_ref string, pep_tier int, "
    "media_confidence double, created_at timestamp"
)
DECISION = (
    "decision_id string, screening_id string, client_id string, trace_id string, outcome string, "
    "reason_codes array<string>, top_match_id string, decided_at timestamp"
)
AUDIT = "audit_id string, decision_id string, trace_id string, snapshot string, created_at timestamp"
IDEMPOTENCY = "key string, processed_at timestamp"
DEAD_LETTER = (
    "id string, topic string, partition int, offset bigint, trace_id string, client_id string, stage string, "
    "error_type string, error_msg string, payload string, created_at timestamp"
)
RECONCILIATION_RUN = (
    "id string, provider_id string, list_type string, old_version string, new_version string, "
    "clients_rescreened int, newly_flagged int, newly_cleared int, started_at timestamp, finished_at timestamp"
)
STAGE_LOG = (
    "ts timestamp, level string, trace_id string, client_id string, stage string, status string, component string, "
    "duration_ms bigint, detail string"
)
DQ_RESULT = (
    "`check` string, risk string, passed boolean, breach_count bigint, breaches array<string>, detail string"
)
VIOLATION = "`check` string, locator string, detail string"

"""Field names, allowed values and explicit Spark schemas shared by the package."""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------
FIELD_NAMES = (
    "owner_name",
    "father_or_spouse_name",
    "survey_number",
    "khasra_number",
    "khata_number",
    "area",
    "area_unit",
    "village",
    "tehsil",
    "district",
    "land_classification",
    "mutation_number",
    "registration_number",
    "record_date",
)
REQUIRED_FIELDS = ("owner_name", "survey_number", "area", "village", "tehsil", "district")
TYPED_FIELDS = ("record_date", "area")

DOCUMENT_STATUSES = (
    "UPLOADED", "PREPROCESSING", "OCR_PROCESSING", "EXTRACTION", "VALIDATION", "PROCESSING", "EXTRACTED",
    "VALIDATION_FAILED", "REVIEW_REQUIRED", "READY_FOR_APPROVAL", "APPROVED", "REJECTED", "FAILED",
)
JOB_STATUSES = ("PENDING", "RUNNING", "SUCCEEDED", "FAILED", "CANCELLED")
RECORD_STATUSES = ("DRAFT", "PROCESSING", "REVIEW_REQUIRED", "READY_FOR_APPROVAL", "APPROVED", "REJECTED")
TERMINAL_STATUSES = ("APPROVED", "REJECTED")
EXTRACTION_STATUSES = ("EXTRACTED", "MISSING", "UNCERTAIN", "CONFLICT", "ERROR")
VALIDATION_STATUSES = ("NOT_CHECKED", "PASS", "WARNING", "FAIL", "REVIEW_REQUIRED")
SEVERITIES = ("INFO", "WARNING", "ERROR", "CRITICAL")
TASK_STATUSES = ("PENDING", "IN_REVIEW", "COMPLETED", "CANCELLED")
OPEN_TASK_STATUSES = ("PENDING", "IN_REVIEW")
PRIORITIES = ("LOW", "MEDIUM", "HIGH", "URGENT")
REFERENCE_TYPES = ("district", "tehsil", "village", "land_classification")
REFERENCE_STATUSES = ("active", "inactive")
ROLE_NAMES = ("operator", "verifier", "admin")
USER_STATUSES = ("active", "inactive", "suspended")
BANDS = ("HIGH", "MEDIUM", "LOW", "REVIEW_REQUIRED")
FIELD_VERDICTS = ("CORRECT", "INCORRECT", "MISSING", "HALLUCINATED", "PARTIALLY_CORRECT")
# ----------------------------------------------------------------------------

ISSUE = "struct<rule_id:string,field_name:string,status:string,severity:string,message:string>"
FIELD_RESULT = "struct<value:string,confidence:double,status:string>"
LINE = "struct<text:string,confidence:double,box:array<double>>"
PAGE = f"struct<page_number:int,text:string,confidence:double,lines:array<{LINE}>,width:int,height:int>"

MANIFEST_FILE = (
    "version string, documents array<struct<id:string,file:string,ground_truth:string,difficulty:string,"
    "language:string,attributes:array<string>,purpose:string>>"
)
OCR_FILE = (
    "document_id string, engine string, engine_version string, source_file string, elapsed_seconds double, "
    f"pages array<{PAGE}>"
)
MODEL_OUTPUT_FILE = (
    "id string, failed boolean, error_code string, error_message string, provider string, model string, "
    "prompt_version string, schema_version string, elapsed_seconds double, "
    f"fields map<string,{FIELD_RESULT}>, values map<string,string>"
)
GROUND_TRUTH_TEXT_FILE = "id string, text string, lines array<string>"
GROUND_TRUTH_RECORD_FILE = "id string, " + ", ".join(f"{name} string" for name in FIELD_NAMES)
RECORD_PAYLOAD = ", ".join(f"{name} string" for name in FIELD_NAMES)
AUDIT = (
    "id string, user_id string, entity_type string, entity_id string, action string, "
    "old_value string, new_value string, metadata string, timestamp timestamp"
)

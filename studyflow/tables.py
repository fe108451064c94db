"""Table schemas and the fixed values every pipeline agrees on."""

from __future__ import annotations

# --- Fixed values: identifiers, bands, weights and paths that results depend on -------------------

CERTIFICATION_ID = "CERT_SNOWPRO_CORE"

# certification_id, certification_code, certification_name, exam_version, description
CERTIFICATIONS = [
    (
        "CERT_SNOWPRO_CORE",
        "COF-C03",
        "SnowPro Core Certification",
        "COF-C03",
        "Validates practical knowledge of the Snowflake AI Data Cloud",
    ),
]

# experience_level_code, experience_level_name, min_years, max_years, recommended_weeks,
# weekly_study_hours, display_order
EXPERIENCE_LEVELS = [
    ("FRESHER", "Fresher", "0.0", "0.0", 12, 8, 1),
    ("EXP_0_5", "0-5 Years Snowflake Experience", "0.1", "5.0", 10, 7, 2),
    ("EXP_5_9", "5-9 Years Snowflake Experience", "5.1", "9.0", 8, 6, 3),
    ("EXP_9_PLUS", "9+ Years Snowflake Experience", "9.1", None, 6, 5, 4),
]

# domain_id, domain_name, exam_weight_percent, domain_order, description
EXAM_DOMAINS = [
    (
        "DOMAIN_01",
        "Snowflake AI Data Cloud Features and Architecture",
        "31.00",
        1,
        "Architecture, Snowflake objects, storage, interfaces and platform features",
    ),
    (
        "DOMAIN_02",
        "Performance Optimization, Querying and Transformation",
        "21.00",
        2,
        "Querying, transformation, warehouse performance and optimization",
    ),
    (
        "DOMAIN_03",
        "Account Management and Data Governance",
        "20.00",
        3,
        "Security, roles, privileges, account administration and governance",
    ),
    (
        "DOMAIN_04",
        "Data Loading, Unloading and Connectivity",
        "18.00",
        4,
        "Stages, file formats, loading, unloading and client connectivity",
    ),
    (
        "DOMAIN_05",
        "Data Collaboration",
        "10.00",
        5,
        "Secure data sharing, listings and collaboration capabilities",
    ),
]

# path_id, experience_level_code, path_name, duration_weeks, weekly_study_hours, description
LEARNING_PATHS = [
    (
        "PATH_FRESHER",
        "FRESHER",
        "SnowPro Core Fresher Path",
        12,
        8,
        "Detailed learning path with additional fundamentals and hands-on practice",
    ),
    (
        "PATH_0_5",
        "EXP_0_5",
        "SnowPro Core 0-5 Years Path",
        10,
        7,
        "Structured learning path for early-career professionals",
    ),
    (
        "PATH_5_9",
        "EXP_5_9",
        "SnowPro Core 5-9 Years Path",
        8,
        6,
        "Accelerated learning path for experienced professionals",
    ),
    (
        "PATH_9_PLUS",
        "EXP_9_PLUS",
        "SnowPro Core 9+ Years Path",
        6,
        5,
        "Focused learning path for senior professionals",
    ),
]

# Pipeline names as they appear in rejects, ledger and run log.
TOPICS_PIPELINE = "STUDY_TOPICS_PIPELINE"
LEARNERS_PIPELINE = "LEARNER_INFORMATION"
ACTIVITY_PIPELINE = "LEARNER_PROGRESS"

# --- Schemas --------------------------------------------------------------------------------------

TOPIC_INBOX = [
    "topic_id", "domain_id", "topic_name", "topic_description",
    "difficulty_level", "estimated_hours", "topic_order",
]
LEARNER_INBOX = [
    "source_record_id", "employee_id", "learner_name", "email",
    "department_name", "snowflake_experience_years",
]
ACTIVITY_INBOX = [
    "activity_id", "employee_id", "topic_id", "event_type",
    "duration_minutes", "completion_percent", "activity_timestamp", "notes",
]
LINEAGE = ["source_file_name", "source_row_number"]

CERTIFICATION_SCHEMA = """
    certification_id string, certification_code string, certification_name string,
    exam_version string, description string, active_flag boolean,
    created_at timestamp_ntz, updated_at timestamp_ntz"""

LEVEL_SCHEMA = """
    experience_level_code string, experience_level_name string,
    min_years decimal(3,1), max_years decimal(3,1), recommended_weeks decimal(3,0),
    weekly_study_hours decimal(3,0), display_order decimal(2,0), active_flag boolean,
    created_at timestamp_ntz, updated_at timestamp_ntz"""

DOMAIN_SCHEMA = """
    domain_id string, certification_id string, domain_name string,
    exam_weight_percent decimal(5,2), domain_order decimal(2,0), description string,
    active_flag boolean, created_at timestamp_ntz, updated_at timestamp_ntz"""

TOPIC_SCHEMA = """
    topic_id string, domain_id string, topic_name string, topic_description string,
    difficulty_level string, estimated_hours decimal(5,1), topic_order decimal(3,0),
    active_flag boolean, created_at timestamp_ntz, updated_at timestamp_ntz"""

PATH_SCHEMA = """
    path_id string, certification_id string, experience_level_code string, path_name string,
    duration_weeks decimal(3,0), weekly_study_hours decimal(3,0), description string,
    active_flag boolean, created_at timestamp_ntz, updated_at timestamp_ntz"""

PLAN_SCHEMA = """
    path_id string, topic_id string, planned_week decimal(3,0), recommended_hours decimal(5,1),
    required_flag boolean, created_at timestamp_ntz, updated_at timestamp_ntz"""

RESOURCE_SCHEMA = """
    resource_id string, topic_id string, resource_title string, resource_type string,
    resource_url string, is_official boolean, resource_order decimal(3,0), active_flag boolean,
    created_at timestamp_ntz, updated_at timestamp_ntz"""

LEARNER_SCHEMA = """
    learner_id string, employee_id string, learner_name string, email string,
    department_name string, snowflake_experience_years decimal(4,1),
    experience_level_code string, joined_date date, active_flag boolean,
    created_at timestamp_ntz, updated_at timestamp_ntz"""

ENROLLMENT_SCHEMA = """
    enrollment_id string, learner_id string, certification_id string, path_id string,
    enrolled_date date, target_completion_date date, target_exam_date date,
    enrollment_status string, created_at timestamp_ntz, updated_at timestamp_ntz"""

PROGRESS_SCHEMA = """
    enrollment_id string, topic_id string, progress_status string,
    completion_percent decimal(5,2), hours_spent decimal(7,2), started_at timestamp_ntz,
    completed_at timestamp_ntz, last_activity_at timestamp_ntz, updated_at timestamp_ntz"""

EVENT_SCHEMA = """
    event_id string, enrollment_id string, topic_id string, event_type string,
    event_timestamp timestamp_ntz, duration_minutes decimal(8,0),
    completion_percent decimal(5,2), event_source string, notes string,
    processed_at timestamp_ntz"""

ASSESSMENT_SCHEMA = """
    assessment_id string, enrollment_id string, assessment_name string, assessment_type string,
    domain_id string, score_percent decimal(5,2), passed_flag boolean,
    attempted_at timestamp_ntz, notes string, created_at timestamp_ntz"""

REJECT_SCHEMA = """
    rejection_id string, pipeline_name string, source_record_id string,
    source_file_name string, source_row_number bigint, raw_record variant,
    rejection_reason string, rejected_at timestamp_ntz, resolved_flag boolean,
    resolved_at timestamp_ntz"""

RESOLUTION_SCHEMA = """
    rejection_id string, source_record_id string, pipeline_name string, resolved_at timestamp_ntz"""

LEDGER_SCHEMA = """
    pipeline_name string, source_record_id string, processed_at timestamp_ntz,
    processing_result string"""

RUN_LOG_SCHEMA = """
    run_id string, pipeline_name string, started_at timestamp_ntz, completed_at timestamp_ntz,
    run_status string, records_received bigint, records_accepted bigint,
    records_rejected bigint, run_message string"""

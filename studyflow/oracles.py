"""SQL counterparts of the queries, written from the rules for a second engine (DuckDB).

``VIEWS`` holds named subqueries; a statement gets the ones it mentions, directly or through others.
"""

from __future__ import annotations

import re

LADDER = """CASE WHEN {y} = 0 THEN 'FRESHER' WHEN {y} <= 5 THEN 'EXP_0_5'
     WHEN {y} <= 9 THEN 'EXP_5_9' ELSE 'EXP_9_PLUS' END"""
CENTS = "CAST(round(c_acctbal * 100) AS BIGINT)"


def _key(prefix: str, subject: str) -> str:
    return f"'{prefix}_' || left(sha256({subject}), 20)"


def _learner_id(employee: str) -> str:
    return _key("LRN", f"upper(trim({employee}))")


def _enrollment_id(employee: str) -> str:
    return _key("ENR", f"upper(trim({employee})) || '_CERT_SNOWPRO_CORE'")


def _money(h: str, p: int) -> str:
    """Hundredths as a two-decimal number."""
    return f"CAST(CAST({h} AS DECIMAL(18,0)) * 0.01 AS DECIMAL({p},2))"


def _cents(c: str) -> str:
    return f"CAST({c} * 100 AS BIGINT)"


TOPIC_OF = "'D0' || ((k % 35) // 7 + 1) || '_T0' || (k % 35 % 7 + 1)"
KIND = """CASE event_type WHEN 'view' THEN 'STUDIED' WHEN 'click' THEN 'STARTED'
     WHEN 'purchase' THEN 'COMPLETED' WHEN 'signup' THEN 'PROGRESS_UPDATED' ELSE event_type END"""
PCT = "CAST(json_extract_string(props, '$.k') AS INT)"
STAMP = r"'\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?'"
REGISTERED = "DATE '2024-01-01'"
AS_OF = "DATE '2024-02-01'"
NOW = "TIMESTAMP '2024-01-01'"
LATER = "TIMESTAMP '2024-02-01'"

VIEWS: dict[str, str] = {
    "paths": """
        SELECT * FROM (VALUES
            ('PATH_FRESHER', 'FRESHER', 'SnowPro Core Fresher Path', 12, 8),
            ('PATH_0_5', 'EXP_0_5', 'SnowPro Core 0-5 Years Path', 10, 7),
            ('PATH_5_9', 'EXP_5_9', 'SnowPro Core 5-9 Years Path', 8, 6),
            ('PATH_9_PLUS', 'EXP_9_PLUS', 'SnowPro Core 9+ Years Path', 6, 5)
        ) v(path_id, experience_level_code, path_name, duration_weeks, weekly_study_hours)""",
    "levels": """
        SELECT * FROM (VALUES
            ('FRESHER', 'Fresher', 0.0, 0.0, 12, 1),
            ('EXP_0_5', '0-5 Years Snowflake Experience', 0.1, 5.0, 10, 2),
            ('EXP_5_9', '5-9 Years Snowflake Experience', 5.1, 9.0, 8, 3),
            ('EXP_9_PLUS', '9+ Years Snowflake Experience', 9.1, NULL, 6, 4)
        ) v(experience_level_code, experience_level_name, min_years, max_years,
            recommended_weeks, display_order)""",
    "domains": """
        SELECT 'DOMAIN_0' || (r_regionkey + 1) AS domain_id, r_name AS domain_name,
               CAST(CASE r_regionkey WHEN 0 THEN 31 WHEN 1 THEN 21 WHEN 2 THEN 20
                    WHEN 3 THEN 18 WHEN 4 THEN 10 END AS DECIMAL(5,2)) AS exam_weight_percent,
               CAST(r_regionkey + 1 AS DECIMAL(2,0)) AS domain_order
        FROM region""",
    "topic_inbox": """
        SELECT CASE WHEN k % 23 = 5 THEN 'X01_T01' WHEN k % 29 = 3 THEN 'd01_t01'
                    ELSE 'D0' || dom || '_T0' || num END AS topic_id,
               CASE WHEN k % 31 = 7 THEN NULL WHEN k % 37 = 9 THEN 'DOMAIN_6'
                    ELSE 'DOMAIN_0' || dom END AS domain_id,
               CASE WHEN k % 41 = 11 THEN '  ' ELSE p_name || ' ' || k END AS topic_name,
               p_type || ' ' || p_brand AS topic_description,
               CASE WHEN k % 43 = 13 THEN 'EXPERT'
                    ELSE CASE p_size % 3 WHEN 0 THEN 'Beginner' WHEN 1 THEN ' intermediate '
                         ELSE 'ADVANCED' END END AS difficulty_level,
               CASE WHEN k % 47 = 17 THEN 'abc' WHEN k % 53 = 19 THEN '-2'
                    WHEN k % 59 = 23 THEN NULL
                    ELSE (1 + p_size % 5) || '.' || (p_size % 10) END AS estimated_hours,
               CASE WHEN k % 61 = 29 THEN '0' WHEN k % 67 = 31 THEN 'x'
                    ELSE CAST((dom - 1) * 7 + num AS VARCHAR) END AS topic_order,
               'topics_' || (k % 3) || '.csv' AS source_file_name,
               k AS source_row_number,
               TIMESTAMP '2024-01-01' + to_seconds(k // 10) AS ingested_at
        FROM (SELECT p_partkey AS k, p_name, p_type, p_brand, p_size,
                     p_partkey % 6 + 1 AS dom, (p_partkey // 6) % 7 + 1 AS num FROM part)""",
    "topic_checked": """
        SELECT t.*, TRY_CAST(estimated_hours AS DECIMAL(5,1)) AS hours_value,
               TRY_CAST(topic_order AS DECIMAL(3,0)) AS order_value,
               CASE
                 WHEN NOT regexp_full_match(coalesce(trim(topic_id), ''), 'D[0-9]{2}_T[0-9]{2}')
                   THEN 'Missing or invalid topic ID'
                 WHEN NOT regexp_full_match(coalesce(trim(domain_id), ''), 'DOMAIN_[0-9]{2}')
                   THEN 'Missing or invalid domain ID'
                 WHEN domain_id NOT IN (SELECT domain_id FROM domains)
                   THEN 'Domain does not exist in the approved domain list'
                 WHEN coalesce(trim(topic_name), '') = '' THEN 'Topic name is required'
                 WHEN upper(coalesce(trim(difficulty_level), ''))
                      NOT IN ('BEGINNER', 'INTERMEDIATE', 'ADVANCED')
                   THEN 'Difficulty level is invalid'
                 WHEN coalesce(TRY_CAST(estimated_hours AS DECIMAL(5,1)), 0) <= 0
                   THEN 'Estimated hours must be a positive number'
                 WHEN coalesce(TRY_CAST(topic_order AS DECIMAL(3,0)), 0) <= 0
                   THEN 'Topic order must be a positive whole number'
               END AS validation_error
        FROM topic_inbox t""",
    "topics": """
        SELECT topic_id, domain_id, topic_name, topic_description,
               upper(trim(difficulty_level)) AS difficulty_level,
               hours_value AS estimated_hours, order_value AS topic_order
        FROM topic_checked WHERE validation_error IS NULL
        QUALIFY row_number() OVER (PARTITION BY topic_id
            ORDER BY ingested_at DESC, source_file_name DESC, source_row_number DESC) = 1""",
    "positions": """
        SELECT topic_id, estimated_hours, topic_order,
               row_number() OVER (ORDER BY topic_order, topic_id) AS topic_position,
               count(*) OVER () AS total_topics
        FROM topics""",
    "weeks": """
        SELECT path_id, topic_id, topic_position, estimated_hours, weekly_study_hours,
               CAST(least(duration_weeks,
                    (topic_position * duration_weeks + total_topics - 1) // total_topics)
                    AS DECIMAL(3,0)) AS planned_week
        FROM positions CROSS JOIN paths""",
    "plan": """
        SELECT path_id, topic_id, planned_week,
               CAST(CAST((2 * a + b) // (2 * b) AS DECIMAL(18,0)) * 0.1 AS DECIMAL(5,1))
                   AS recommended_hours,
               TRUE AS required_flag
        FROM (SELECT *, weekly_study_hours * CAST(estimated_hours * 10 AS BIGINT) * 10 AS a,
                     CAST(sum(CAST(estimated_hours * 10 AS BIGINT))
                          OVER (PARTITION BY path_id, planned_week) AS BIGINT) AS b
              FROM weeks)""",
    "weekly": """
        SELECT p.path_id, p.path_name, p.experience_level_code,
               CAST(p.duration_weeks AS DECIMAL(3,0)) AS duration_weeks,
               CAST(p.weekly_study_hours AS DECIMAL(3,0)) AS weekly_study_hours,
               pl.planned_week, pl.recommended_hours, pl.required_flag,
               d.domain_id, d.domain_name, d.domain_order, d.exam_weight_percent,
               t.topic_id, t.topic_name, t.topic_description, t.difficulty_level,
               t.estimated_hours, t.topic_order
        FROM paths p JOIN plan pl USING (path_id) JOIN topics t USING (topic_id)
             JOIN domains d USING (domain_id)""",
    "learner_inbox": f"""
        SELECT CASE WHEN k % 101 = 7 THEN '' WHEN k % 89 = 11 THEN 'LRN-' || (k + 1)
                    ELSE 'LRN-' || k END AS source_record_id,
               CASE WHEN k % 103 = 9 THEN NULL WHEN k % 17 = 3 THEN 'emp-' || (k - 1)
                    ELSE 'EMP-' || k END AS employee_id,
               CASE WHEN k % 107 = 13 THEN ' ' ELSE c_name END AS learner_name,
               CASE WHEN k % 97 = 21 THEN 'no-at-sign' WHEN k % 109 = 23 THEN NULL
                    ELSE ' User' || k || '@Example.com ' END AS email,
               c_mktsegment AS department_name,
               CASE WHEN k % 113 = 25 THEN 'abc' WHEN k % 127 = 27 THEN NULL
                    ELSE CASE WHEN cents < 0 THEN '-' ELSE '' END || (abs(cents) // 100000) || '.'
                         || lpad(CAST(abs(cents) // 1000 % 100 AS VARCHAR), 2, '0')
               END AS snowflake_experience_years,
               'learners_' || (k % 4) || '.csv' AS source_file_name,
               k AS source_row_number
        FROM (SELECT c_custkey AS k, c_name, c_mktsegment, {CENTS} AS cents FROM customer)""",
    "learner_batch": """
        SELECT trim(source_record_id) AS source_record_id, trim(employee_id) AS employee_id,
               trim(learner_name) AS learner_name, lower(trim(email)) AS email,
               trim(department_name) AS department_name,
               trim(snowflake_experience_years) AS snowflake_experience_years,
               source_file_name, source_row_number
        FROM learner_inbox""",
    "learner_ledger": """
        SELECT 'LRN-' || (o_orderkey * 13) AS source_record_id FROM orders""",
    "learner_rules": """
        SELECT *, TRY_CAST(snowflake_experience_years AS DECIMAL(4,1)) AS years,
               CASE
                 WHEN coalesce(source_record_id, '') = '' THEN 'Source record ID is required.'
                 WHEN coalesce(employee_id, '') = '' THEN 'Employee ID is required.'
                 WHEN coalesce(learner_name, '') = '' THEN 'Learner name is required.'
                 WHEN coalesce(email, '') = '' THEN 'Email is required.'
                 WHEN email NOT LIKE '%@%.%' THEN 'Email format is invalid.'
                 WHEN coalesce(snowflake_experience_years, '') = ''
                   THEN 'Snowflake experience is required.'
                 WHEN TRY_CAST(snowflake_experience_years AS DECIMAL(4,1)) IS NULL
                   THEN 'Snowflake experience must be numeric.'
                 WHEN TRY_CAST(snowflake_experience_years AS DECIMAL(4,1)) < 0
                   THEN 'Snowflake experience must be zero or greater.'
               END AS row_error
        FROM learner_batch""",
    "learner_checked": """
        SELECT *, CASE
                 WHEN row_error IS NOT NULL THEN row_error
                 WHEN source_record_id IN (SELECT source_record_id FROM learner_batch
                                           WHERE source_record_id IS NOT NULL
                                           GROUP BY 1 HAVING count(*) > 1)
                   THEN 'Duplicate source record ID exists in the uploaded batch.'
                 WHEN source_record_id IN (SELECT source_record_id FROM learner_ledger)
                   THEN 'Source record has already been processed successfully.'
               END AS validation_error
        FROM learner_rules""",
    "placed": f"""
        SELECT c.*, p.path_id, p.duration_weeks, p.experience_level_code,
               {_learner_id('employee_id')} AS learner_id,
               {_enrollment_id('employee_id')} AS enrollment_id
        FROM learner_checked c
        JOIN paths p ON p.experience_level_code = {LADDER.format(y='c.years')}
        WHERE validation_error IS NULL""",
    "registered_last": """
        SELECT learner_id, enrollment_id,
               first(employee_id ORDER BY source_row_number, source_file_name) AS employee_id,
               last(learner_name ORDER BY source_row_number, source_file_name) AS learner_name,
               last(email ORDER BY source_row_number, source_file_name) AS email,
               last(department_name ORDER BY source_row_number, source_file_name)
                   AS department_name,
               last(years ORDER BY source_row_number, source_file_name)
                   AS snowflake_experience_years,
               last(experience_level_code ORDER BY source_row_number, source_file_name)
                   AS experience_level_code,
               last(path_id ORDER BY source_row_number, source_file_name) AS path_id,
               DATE '2024-01-01' + CAST(7 * last(duration_weeks
                   ORDER BY source_row_number, source_file_name) AS INT) AS target_completion_date,
               DATE '2024-01-01' + CAST(7 + 7 * last(duration_weeks
                   ORDER BY source_row_number, source_file_name) AS INT) AS target_exam_date
        FROM placed GROUP BY learner_id, enrollment_id""",
    "people": f"""
        SELECT e.*, p.path_id, p.duration_weeks, p.experience_level_code,
               {_learner_id('employee_id')} AS learner_id,
               {_enrollment_id('employee_id')} AS enrollment_id,
               {REGISTERED} + CAST(7 * duration_weeks AS INT) AS target_completion_date,
               {REGISTERED} + CAST(7 * duration_weeks + 7 AS INT) AS target_exam_date
        FROM (SELECT 'EMP-' || c_custkey AS employee_id, c_name AS learner_name,
                     'user' || c_custkey || '@example.com' AS email,
                     c_mktsegment AS department_name, c_nationkey,
                     CAST(CAST({CENTS} // 10000 AS DECIMAL(18,0)) * 0.1 AS DECIMAL(4,1))
                         AS snowflake_experience_years
              FROM customer WHERE {CENTS} >= 0) e
        JOIN paths p ON p.experience_level_code = {LADDER.format(y='snowflake_experience_years')}""",
    "enrollments": """
        SELECT enrollment_id, learner_id, 'CERT_SNOWPRO_CORE' AS certification_id, path_id,
               DATE '2024-01-01' AS enrolled_date, target_completion_date, target_exam_date,
               CASE WHEN c_nationkey = 24 THEN 'CLOSED' ELSE 'ACTIVE' END AS enrollment_status
        FROM people""",
    "order_enrollments": f"""
        SELECT 'ENR-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS enrollment_id,
               {_learner_id("('EMP-' || o_custkey)")} AS learner_id,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'CERT_OTHER'
                    ELSE 'CERT_SNOWPRO_CORE' END AS certification_id,
               CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' ELSE 'ACTIVE' END
                   AS enrollment_status,
               o_orderdate AS created_at
        FROM orders""",
    "newest_enrollment": """
        SELECT p.employee_id, e.enrollment_id
        FROM people p JOIN order_enrollments e USING (learner_id)
        WHERE e.certification_id = 'CERT_SNOWPRO_CORE' AND e.enrollment_status = 'ACTIVE'
        QUALIFY row_number() OVER (PARTITION BY p.employee_id
            ORDER BY e.created_at DESC, e.enrollment_id DESC) = 1""",
    "learning_events": f"""
        SELECT 'EVT-' || k AS event_id, {_enrollment_id("('EMP-' || user_id)")} AS enrollment_id,
               {TOPIC_OF} AS topic_id,
               CASE event_type WHEN 'error' THEN 'STARTED' ELSE {KIND} END AS event_type,
               ts AS event_timestamp, CAST(floor(value) AS BIGINT) AS minutes,
               CASE WHEN event_type = 'purchase' THEN 100 ELSE {PCT} END AS percent,
               CAST(ts AS DATE) AS batch_day
        FROM (SELECT event_id AS k, * FROM events)""",
    "initial_progress": """
        SELECT e.enrollment_id, p.topic_id FROM enrollments e JOIN plan p USING (path_id)
        WHERE e.enrollment_status = 'ACTIVE' AND p.required_flag""",
    "day_rollup": """
        SELECT enrollment_id, topic_id, batch_day, sum(minutes) AS minutes, max(percent) AS percent,
               min(event_timestamp) AS first_at, max(event_timestamp) AS last_at
        FROM learning_events GROUP BY ALL""",
    "day_steps": """
        SELECT *, max(percent) OVER w AS running,
               row_number() OVER w AS step,
               count(*) OVER (PARTITION BY enrollment_id, topic_id) AS steps
        FROM day_rollup
        WINDOW w AS (PARTITION BY enrollment_id, topic_id ORDER BY batch_day
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "folded": f"""
        SELECT enrollment_id, topic_id,
               CASE WHEN max(running) >= 100 THEN 'COMPLETED'
                    WHEN max(running) > 0 OR sum(minutes) > 0 THEN 'IN_PROGRESS'
                    ELSE 'NOT_STARTED' END AS progress_status,
               CAST(max(running) AS DECIMAL(5,2)) AS completion_percent,
               {_money('sum(CAST(round(minutes * 100 / 60.0) AS BIGINT))', 7)} AS hours_spent,
               max(CASE WHEN step = 1 THEN first_at END) AS started_at,
               min(CASE WHEN running >= 100 THEN last_at END) AS completed_at,
               max(CASE WHEN step = steps THEN last_at END) AS last_activity_at
        FROM day_steps GROUP BY enrollment_id, topic_id""",
    "progress": """
        SELECT coalesce(i.enrollment_id, f.enrollment_id) AS enrollment_id,
               coalesce(i.topic_id, f.topic_id) AS topic_id,
               coalesce(f.progress_status, 'NOT_STARTED') AS progress_status,
               coalesce(f.completion_percent, CAST(0 AS DECIMAL(5,2))) AS completion_percent,
               coalesce(f.hours_spent, CAST(0 AS DECIMAL(7,2))) AS hours_spent,
               f.started_at, f.completed_at, f.last_activity_at
        FROM initial_progress i FULL OUTER JOIN folded f
          ON i.enrollment_id = f.enrollment_id AND i.topic_id = f.topic_id""",
    "planned": """
        SELECT e.enrollment_id, e.path_id, p.topic_id,
               coalesce(g.progress_status, 'NOT_STARTED') AS progress_status,
               coalesce(g.completion_percent, CAST(0 AS DECIMAL(5,2))) AS completion_percent,
               coalesce(g.hours_spent, CAST(0 AS DECIMAL(7,2))) AS hours_spent
        FROM enrollments e JOIN plan p USING (path_id)
        LEFT JOIN progress g ON g.enrollment_id = e.enrollment_id AND g.topic_id = p.topic_id""",
    "progress_view": f"""
        SELECT l.learner_id, l.learner_name, l.department_name, l.snowflake_experience_years,
               l.experience_level_code, e.enrollment_id, e.certification_id, e.enrollment_status,
               e.enrolled_date, e.target_completion_date, e.target_exam_date,
               p.path_id, p.path_name,
               CAST(p.duration_weeks AS DECIMAL(3,0)) AS duration_weeks,
               CAST(p.weekly_study_hours AS DECIMAL(3,0)) AS weekly_study_hours,
               count(*) AS total_topics,
               count(*) FILTER (progress_status = 'COMPLETED') AS completed_topics,
               count(*) FILTER (progress_status = 'IN_PROGRESS') AS in_progress_topics,
               count(*) FILTER (progress_status = 'NOT_STARTED') AS not_started_topics,
               {_money(f"(2 * CAST(sum({_cents('completion_percent')}) AS BIGINT) + count(*)) // (2 * count(*))", 5)}
                   AS overall_completion_percent,
               CAST(sum(hours_spent) AS DECIMAL(12,2)) AS total_hours_spent,
               CAST(least(p.duration_weeks, greatest(1, date_diff('day',
                    date_trunc('week', e.enrolled_date), date_trunc('week', {AS_OF})) // 7 + 1))
                    AS BIGINT) AS current_study_week,
               CAST(date_diff('day', {AS_OF}, e.target_completion_date) AS INT)
                   AS days_to_target_completion
        FROM people l JOIN enrollments e ON e.learner_id = l.learner_id
             JOIN paths p ON p.path_id = e.path_id
             JOIN planned g ON g.enrollment_id = e.enrollment_id
        GROUP BY ALL""",
    "domain_view": f"""
        SELECT e.enrollment_id, e.learner_id, e.path_id, d.domain_id, d.domain_name,
               d.domain_order, d.exam_weight_percent,
               count(*) AS total_domain_topics,
               count(*) FILTER (progress_status = 'COMPLETED') AS completed_domain_topics,
               {_money(f"(2 * CAST(sum({_cents('completion_percent')}) AS BIGINT) + count(*)) // (2 * count(*))", 5)}
                   AS domain_completion_percent,
               {_money(f"(2 * CAST(sum({_cents('completion_percent')}) AS BIGINT) * {_cents('exam_weight_percent')} + 10000 * count(*)) // (20000 * count(*))", 5)}
                   AS weighted_progress_contribution,
               CAST(sum(hours_spent) AS DECIMAL(12,2)) AS domain_hours_spent
        FROM enrollments e JOIN planned g ON g.enrollment_id = e.enrollment_id
             JOIN topics t ON t.topic_id = g.topic_id JOIN domains d ON d.domain_id = t.domain_id
        GROUP BY e.enrollment_id, e.learner_id, e.path_id, d.domain_id, d.domain_name,
                 d.domain_order, d.exam_weight_percent""",
    "weighted": """
        SELECT enrollment_id,
               CAST(sum(weighted_progress_contribution) AS DECIMAL(7,2))
                   AS weighted_learning_progress
        FROM domain_view GROUP BY enrollment_id""",
    "assessments": f"""
        SELECT 'ASM-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS assessment_id,
               {_enrollment_id("('EMP-' || o_custkey)")} AS enrollment_id,
               'Exam ' || o_orderpriority AS assessment_name,
               CASE WHEN o_orderstatus = 'F' THEN 'MOCK_EXAM' ELSE 'PRACTICE_TEST' END
                   AS assessment_type,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'DOMAIN_0' || (o_custkey % 5 + 1) END
                   AS domain_id,
               {_money('CAST(round(o_totalprice * 100) AS BIGINT) // 5000', 5)} AS score_percent,
               o_orderdate AS attempted_at
        FROM orders""",
    "newest_assessment": """
        SELECT enrollment_id, assessment_name AS latest_assessment_name,
               assessment_type AS latest_assessment_type, score_percent AS latest_assessment_score,
               score_percent >= 75 AS latest_assessment_passed,
               attempted_at AS latest_assessment_date
        FROM assessments WHERE domain_id IS NULL
        QUALIFY row_number() OVER (PARTITION BY enrollment_id
            ORDER BY attempted_at DESC, assessment_id DESC) = 1""",
    "readiness_rows": """
        SELECT v.learner_id, v.learner_name, v.department_name, v.snowflake_experience_years,
               v.experience_level_code, v.enrollment_id, v.path_id, v.path_name,
               v.enrollment_status, v.target_completion_date, v.target_exam_date,
               v.overall_completion_percent, v.completed_topics, v.total_topics,
               v.total_hours_spent,
               coalesce(w.weighted_learning_progress, CAST(0 AS DECIMAL(7,2)))
                   AS weighted_learning_progress,
               a.latest_assessment_name, a.latest_assessment_type, a.latest_assessment_score,
               a.latest_assessment_passed, a.latest_assessment_date
        FROM progress_view v LEFT JOIN weighted w USING (enrollment_id)
             LEFT JOIN newest_assessment a USING (enrollment_id)""",
    "scored": f"""
        SELECT *, {_money(f"CASE WHEN latest_assessment_score IS NULL THEN {_cents('weighted_learning_progress')} ELSE (2 * (6 * {_cents('weighted_learning_progress')} + 4 * {_cents('latest_assessment_score')}) + 10) // 20 END", 7)} AS readiness_score
        FROM readiness_rows""",
    "readiness": """
        SELECT *,
               CASE WHEN latest_assessment_score IS NULL AND readiness_score >= 80
                      THEN 'ASSESSMENT_REQUIRED'
                    WHEN latest_assessment_score IS NOT NULL AND readiness_score >= 80
                         AND latest_assessment_score >= 75 THEN 'READY'
                    WHEN readiness_score >= 65 THEN 'ALMOST_READY'
                    WHEN readiness_score > 0 THEN 'IN_PROGRESS'
                    ELSE 'NOT_STARTED' END AS readiness_status,
               CASE WHEN latest_assessment_score IS NULL
                      THEN 'Complete a mock assessment to confirm readiness.'
                    WHEN readiness_score >= 80 AND latest_assessment_score >= 75
                      THEN 'Learner meets the internal readiness criteria.'
                    WHEN readiness_score >= 65
                      THEN 'Continue revision and improve weaker domains.'
                    ELSE 'Continue the assigned learning path.' END AS readiness_recommendation
        FROM scored""",
    "activity_inbox": f"""
        SELECT CASE WHEN k % 101 = 3 THEN NULL WHEN k % 89 = 5 THEN 'ACT-' || (k + 1)
                    ELSE 'ACT-' || k END AS activity_id,
               CASE WHEN k % 103 = 7 THEN '' WHEN k % 19 = 2 THEN 'emp-' || user_id
                    ELSE 'EMP-' || user_id END AS employee_id,
               CASE WHEN k % 107 = 9 THEN NULL
                    WHEN k % 38 >= 35 THEN 'D09_T0' || (k % 38 - 34)
                    ELSE ' ' || lower({TOPIC_OF}) END AS topic_id,
               CASE WHEN k % 109 = 11 THEN ''
                    ELSE CASE event_type WHEN 'view' THEN ' studied ' WHEN 'click' THEN 'Started'
                         WHEN 'purchase' THEN 'COMPLETED' WHEN 'signup' THEN 'PROGRESS_UPDATED'
                         ELSE event_type END END AS event_type,
               CASE WHEN k % 113 = 13 THEN NULL WHEN k % 127 = 15 THEN 'ten'
                    WHEN k % 131 = 17 THEN '-5' WHEN k % 137 = 19 THEN '30.5'
                    ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS duration_minutes,
               CASE WHEN k % 139 = 21 THEN NULL WHEN k % 149 = 23 THEN 'x'
                    WHEN k % 151 = 25 THEN '150' WHEN k % 157 = 27 THEN '-1'
                    ELSE json_extract_string(props, '$.k') END AS completion_percent,
               CASE WHEN k % 163 = 29 THEN NULL WHEN k % 167 = 31 THEN '2024-13-45 00:00:00'
                    WHEN k % 173 = 33 THEN '2024'
                    ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS activity_timestamp,
               'from ' || event_type AS notes,
               'activity_' || (k % 4) || '.csv' AS source_file_name,
               k AS source_row_number
        FROM (SELECT event_id AS k, * FROM events)""",
    "activity_batch": """
        SELECT trim(activity_id) AS activity_id, trim(employee_id) AS employee_id,
               upper(trim(topic_id)) AS topic_id, upper(trim(event_type)) AS event_type,
               trim(duration_minutes) AS duration_minutes,
               trim(completion_percent) AS completion_percent,
               trim(activity_timestamp) AS activity_timestamp, trim(notes) AS notes,
               source_file_name, source_row_number
        FROM activity_inbox""",
    "activity_ledger": """
        SELECT 'ACT-' || (o_orderkey * 17) AS source_record_id FROM orders""",
    "earlier_events": """
        SELECT 'ACT-' || (l_orderkey * 19) AS event_id FROM lineitem""",
    "activity_rules": f"""
        SELECT *, CASE
                 WHEN coalesce(activity_id, '') = '' THEN 'Activity ID is required.'
                 WHEN coalesce(employee_id, '') = '' THEN 'Employee ID is required.'
                 WHEN coalesce(topic_id, '') = '' THEN 'Topic ID is required.'
                 WHEN coalesce(event_type, '') = '' THEN 'Event type is required.'
                 WHEN event_type NOT IN ('STARTED', 'STUDIED', 'COMPLETED')
                   THEN 'Event type must be STARTED, STUDIED or COMPLETED.'
                 WHEN coalesce(duration_minutes, '') = '' THEN 'Duration in minutes is required.'
                 WHEN TRY_CAST(duration_minutes AS DECIMAL(8,0)) IS NULL
                   THEN 'Duration in minutes must be numeric.'
                 WHEN TRY_CAST(duration_minutes AS DECIMAL(8,0)) < 0
                   THEN 'Duration in minutes cannot be negative.'
                 WHEN coalesce(completion_percent, '') = ''
                   THEN 'Completion percentage is required.'
                 WHEN TRY_CAST(completion_percent AS DECIMAL(5,2)) IS NULL
                   THEN 'Completion percentage must be numeric.'
                 WHEN TRY_CAST(completion_percent AS DECIMAL(5,2)) NOT BETWEEN 0 AND 100
                   THEN 'Completion percentage must be between 0 and 100.'
                 WHEN coalesce(activity_timestamp, '') = '' THEN 'Activity timestamp is required.'
                 WHEN NOT regexp_full_match(activity_timestamp, {STAMP})
                      OR TRY_CAST(activity_timestamp AS TIMESTAMP) IS NULL
                   THEN 'Activity timestamp is invalid.'
               END AS row_error
        FROM activity_batch""",
    "activity_repeats": """
        SELECT activity_id FROM activity_batch WHERE activity_id IS NOT NULL
        GROUP BY 1 HAVING count(*) > 1""",
    "activity_checked": """
        SELECT r.*, e.enrollment_id, CASE
                 WHEN row_error IS NOT NULL THEN row_error
                 WHEN activity_id IN (SELECT activity_id FROM activity_repeats)
                   THEN 'Duplicate activity ID exists in the uploaded batch.'
                 WHEN activity_id IN (SELECT source_record_id FROM activity_ledger)
                   THEN 'Activity has already been processed successfully.'
                 WHEN activity_id IN (SELECT event_id FROM earlier_events)
                   THEN 'Activity ID already exists in the learning-events table.'
                 WHEN e.enrollment_id IS NULL
                   THEN 'No active SnowPro Core enrollment was found for the employee.'
                 WHEN NOT EXISTS (SELECT 1 FROM initial_progress g
                                  WHERE g.enrollment_id = e.enrollment_id
                                    AND g.topic_id = r.topic_id)
                   THEN 'Topic is not assigned to the learner enrollment.'
               END AS validation_error
        FROM activity_rules r
        LEFT JOIN (SELECT p.employee_id, n.enrollment_id FROM people p
                   JOIN enrollments n USING (learner_id) WHERE n.enrollment_status = 'ACTIVE') e
          ON e.employee_id = r.employee_id""",
    "csv_events": """
        SELECT activity_id AS event_id, enrollment_id, topic_id, event_type,
               CAST(activity_timestamp AS TIMESTAMP) AS event_timestamp,
               CAST(duration_minutes AS DECIMAL(8,0)) AS duration_minutes,
               CAST(completion_percent AS DECIMAL(5,2)) AS completion_percent,
               'CSV_UPLOAD' AS event_source, notes, TIMESTAMP '2024-01-01' AS processed_at
        FROM activity_checked WHERE validation_error IS NULL""",
    "direct_calls": f"""
        SELECT k AS call_id, {_enrollment_id("('EMP-' || user_id)")} AS enrollment_id,
               CASE WHEN k % 38 >= 35 THEN 'D09_T0' || (k % 38 - 34) ELSE {TOPIC_OF} END
                   AS topic_id,
               CASE WHEN k % 109 = 11 THEN NULL ELSE upper({KIND}) END AS event_type,
               CASE WHEN k % 113 = 13 THEN NULL ELSE CAST(floor(value) AS BIGINT) - 3 END
                   AS minutes,
               CASE WHEN k % 139 = 21 THEN NULL ELSE {PCT} * 2 - 20 END AS percent,
               'from ' || event_type AS notes
        FROM (SELECT event_id AS k, * FROM events)""",
    "direct_checked": """
        SELECT *, CASE
                 WHEN NOT assigned
                   THEN 'Activity rejected: The topic is not assigned to this enrollment.'
                 WHEN event_type IS NULL OR event_type NOT IN
                      ('STARTED', 'STUDIED', 'PROGRESS_UPDATED', 'COMPLETED')
                   THEN 'Activity rejected: Use STARTED, STUDIED, PROGRESS_UPDATED or COMPLETED.'
                 WHEN minutes < 0 THEN 'Activity rejected: Duration cannot be negative.'
                 WHEN final_percent NOT BETWEEN 0 AND 100
                   THEN 'Activity rejected: Completion percentage must be between 0 and 100.'
               END AS validation_error
        FROM (SELECT c.*, g.topic_id IS NOT NULL AS assigned,
                     CASE WHEN event_type = 'COMPLETED' THEN 100 ELSE coalesce(percent, 0) END
                         AS final_percent
              FROM direct_calls c LEFT JOIN initial_progress g
                ON g.enrollment_id = c.enrollment_id AND g.topic_id = c.topic_id)""",
    "lines": """
        SELECT l_orderkey || '-' || l_linenumber AS source_record_id, l_partkey, l_suppkey
        FROM lineitem""",
    "rejects": """
        SELECT 'LEARNER_INFORMATION' AS pipeline_name, source_record_id, source_file_name,
               source_row_number, validation_error AS rejection_reason,
               CAST(json_object('SOURCE_RECORD_ID', source_record_id, 'EMPLOYEE_ID', employee_id,
                    'LEARNER_NAME', learner_name, 'EMAIL', email,
                    'DEPARTMENT_NAME', department_name,
                    'SNOWFLAKE_EXPERIENCE_YEARS', snowflake_experience_years) AS VARCHAR)
                   AS raw_record
        FROM learner_checked WHERE validation_error IS NOT NULL
        UNION ALL
        SELECT 'STUDY_TOPICS_PIPELINE', topic_id, source_file_name, source_row_number,
               validation_error,
               CAST(json_object('TOPIC_ID', topic_id, 'DOMAIN_ID', domain_id,
                    'TOPIC_NAME', topic_name, 'TOPIC_DESCRIPTION', topic_description,
                    'DIFFICULTY_LEVEL', difficulty_level, 'ESTIMATED_HOURS', estimated_hours,
                    'TOPIC_ORDER', topic_order) AS VARCHAR)
        FROM topic_checked WHERE validation_error IS NOT NULL""",
    "dated_rejects": """
        SELECT r.source_record_id, r.source_row_number, r.validation_error AS rejection_reason,
               TIMESTAMP '2024-01-01' + to_minutes(CAST(r.source_row_number % 1440 AS INT))
                   AS rejected_at,
               l.source_record_id IS NOT NULL AS accepted
        FROM learner_checked r
        LEFT JOIN learner_ledger l ON l.source_record_id = r.source_record_id
        WHERE r.validation_error IS NOT NULL""",
    "resolved": """
        SELECT source_record_id, source_row_number, rejection_reason, rejected_at,
               accepted AND rejected_at < TIMESTAMP '2024-01-01 12:00:00' AS resolved_flag,
               CASE WHEN accepted AND rejected_at < TIMESTAMP '2024-01-01 12:00:00'
                    THEN TIMESTAMP '2024-01-01 12:00:00' END AS resolved_at
        FROM dated_rejects""",
    "counts": """
        SELECT 'STUDY_TOPICS_PIPELINE' AS pipeline_name, count(*) AS records_received,
               count(DISTINCT topic_id) FILTER (validation_error IS NULL) AS records_accepted,
               count(*) FILTER (validation_error IS NOT NULL) AS records_rejected
        FROM topic_checked
        UNION ALL
        SELECT 'LEARNER_INFORMATION', count(*), count(*) FILTER (validation_error IS NULL),
               count(*) FILTER (validation_error IS NOT NULL) FROM learner_checked
        UNION ALL
        SELECT 'LEARNER_PROGRESS', count(*), count(*) FILTER (validation_error IS NULL),
               count(*) FILTER (validation_error IS NOT NULL) FROM activity_checked""",
}

TOPIC_TABLE = f"""
    SELECT *, TRUE AS active_flag, {NOW} AS created_at, {NOW} AS updated_at FROM topics"""

STATEMENTS: dict[str, str] = {
    "inbox_csv_read": """
        SELECT nullif(trim(source_record_id), '') AS source_record_id,
               nullif(trim(employee_id), '') AS employee_id,
               nullif(trim(learner_name), '') AS learner_name, nullif(trim(email), '') AS email,
               nullif(trim(department_name), '') AS department_name,
               nullif(trim(snowflake_experience_years), '') AS snowflake_experience_years
        FROM learner_inbox""",
    "inbox_row_number": """
        SELECT 'LRN-' || c_custkey AS source_record_id, CAST(0 AS BIGINT) AS off_by
        FROM customer""",
    "inbox_strict_load": """
        SELECT c_mktsegment AS department_name, count(*) AS row_count FROM customer GROUP BY 1""",
    "inline_reference_tables": """
        SELECT l.experience_level_code, l.experience_level_name,
               CAST(l.min_years AS DECIMAL(3,1)) AS min_years,
               CAST(l.max_years AS DECIMAL(3,1)) AS max_years,
               CAST(l.recommended_weeks AS DECIMAL(3,0)) AS recommended_weeks,
               CAST(l.display_order AS DECIMAL(2,0)) AS display_order,
               p.path_id, p.path_name, CAST(p.duration_weeks AS DECIMAL(3,0)) AS duration_weeks,
               CAST(p.weekly_study_hours AS DECIMAL(3,0)) AS weekly_study_hours,
               count(e.employee_id) AS learner_count
        FROM levels l JOIN paths p USING (experience_level_code)
             LEFT JOIN people e ON e.experience_level_code = l.experience_level_code
        GROUP BY ALL""",
    "inbox_incremental_read": """
        SELECT CAST(CASE WHEN c_mktsegment < 'C' THEN 1 ELSE 2 END AS BIGINT) AS round,
               count(*) AS new_rows FROM customer GROUP BY 1""",
    "batch_snapshot": """
        SELECT coalesce(validation_error, 'valid') AS outcome, count(*) AS row_count
        FROM learner_checked GROUP BY 1""",
    "raw_record_capture": """
        SELECT *, FALSE AS resolved_flag, CAST(36 AS BIGINT) AS rejection_id_length FROM rejects""",
    "append_sink": """
        SELECT pipeline_name, rejection_reason, count(*) AS row_count FROM rejects GROUP BY ALL""",
    "upsert_dimension": f"""
        WITH target AS (
            SELECT topic_id, domain_id, topic_name, topic_description,
                   upper(trim(difficulty_level)) AS difficulty_level,
                   hours_value AS estimated_hours, order_value AS topic_order
            FROM topic_checked WHERE validation_error IS NULL AND topic_id < 'D04'
            QUALIFY row_number() OVER (PARTITION BY topic_id
                ORDER BY ingested_at, source_file_name, source_row_number) = 1),
        source AS (SELECT * FROM topics)
        SELECT *, TRUE AS active_flag,
               CASE WHEN topic_id IN (SELECT topic_id FROM target) THEN {NOW} ELSE {LATER} END
                   AS created_at, {LATER} AS updated_at
        FROM source
        UNION ALL
        SELECT *, FALSE, {NOW}, {NOW} FROM target
        WHERE topic_id NOT IN (SELECT topic_id FROM source)""",
    "upsert_protected": f"""
        SELECT coalesce(t.learner_id, s.learner_id) AS learner_id,
               coalesce(t.employee_id, s.employee_id) AS employee_id,
               CASE WHEN s.learner_id IS NULL THEN t.learner_name ELSE s.learner_name END
                   AS learner_name,
               CASE WHEN s.learner_id IS NULL THEN t.email ELSE s.email END AS email,
               CASE WHEN s.learner_id IS NULL THEN t.department_name ELSE s.department_name END
                   AS department_name,
               CASE WHEN s.learner_id IS NULL THEN t.snowflake_experience_years
                    ELSE s.snowflake_experience_years END AS snowflake_experience_years,
               CASE WHEN s.learner_id IS NULL THEN t.experience_level_code
                    ELSE s.experience_level_code END AS experience_level_code,
               CASE WHEN t.learner_id IS NULL THEN {AS_OF} ELSE {REGISTERED} END AS joined_date,
               s.learner_id IS NOT NULL AS active_flag,
               CASE WHEN t.learner_id IS NULL THEN {LATER} ELSE {NOW} END AS created_at,
               CASE WHEN s.learner_id IS NULL THEN {NOW} ELSE {LATER} END AS updated_at
        FROM people t FULL OUTER JOIN registered_last s ON s.learner_id = t.learner_id""",
    "insert_if_absent": "SELECT * FROM progress",
    "upsert_accumulate": f"""
        WITH state AS (
            SELECT enrollment_id, topic_id, sum(CAST(round(minutes * 100 / 60.0) AS BIGINT)) AS h,
                   sum(minutes) AS minutes, max(running) AS percent,
                   max(CASE WHEN step = 1 THEN first_at END) AS started_at,
                   min(CASE WHEN running >= 100 THEN last_at END) AS completed_at,
                   arg_max(last_at, step) AS last_at
            FROM day_steps WHERE batch_day < DATE '2024-01-16' GROUP BY 1, 2),
        batch AS (
            SELECT enrollment_id, topic_id, sum(minutes) AS minutes, max(percent) AS percent,
                   min(event_timestamp) AS first_at, max(event_timestamp) AS last_at
            FROM learning_events WHERE batch_day >= DATE '2024-01-16' GROUP BY 1, 2),
        both_sides AS (
            SELECT coalesce(s.enrollment_id, b.enrollment_id) AS enrollment_id,
                   coalesce(s.topic_id, b.topic_id) AS topic_id,
                   greatest(coalesce(s.percent, 0), coalesce(b.percent, 0)) AS percent,
                   coalesce(s.minutes, 0) + coalesce(b.minutes, 0) AS minutes,
                   coalesce(s.h, 0) + coalesce(CAST(round(b.minutes * 100 / 60.0) AS BIGINT), 0)
                       AS h,
                   coalesce(s.started_at, b.first_at) AS started_at,
                   s.completed_at AS was_completed, b.last_at AS batch_last,
                   coalesce(b.last_at, s.last_at) AS last_activity_at
            FROM state s FULL OUTER JOIN batch b
              ON s.enrollment_id = b.enrollment_id AND s.topic_id = b.topic_id)
        SELECT enrollment_id, topic_id,
               CASE WHEN percent >= 100 THEN 'COMPLETED'
                    WHEN percent > 0 OR minutes > 0 THEN 'IN_PROGRESS' ELSE 'NOT_STARTED' END
                   AS progress_status,
               CAST(percent AS DECIMAL(5,2)) AS completion_percent, {_money('h', 7)} AS hours_spent,
               started_at,
               CASE WHEN percent >= 100 THEN coalesce(was_completed, batch_last) END
                   AS completed_at,
               last_activity_at,
               CASE WHEN batch_last IS NULL THEN {NOW} ELSE {LATER} END AS updated_at
        FROM both_sides""",
    "normalize_learners": "SELECT * FROM learner_batch",
    "normalize_activity": "SELECT * FROM activity_batch",
    "first_failure_reason": "SELECT source_row_number, row_error AS reason FROM learner_rules",
    "validate_topics": """
        SELECT source_row_number, topic_id, domain_id, hours_value, order_value, validation_error
        FROM topic_checked""",
    "validate_learners": """
        SELECT source_row_number, source_record_id, employee_id, email, validation_error
        FROM learner_checked""",
    "validate_activity": """
        SELECT source_row_number, activity_id, employee_id, topic_id,
               CASE WHEN validation_error IS NULL THEN enrollment_id END AS enrollment_id,
               validation_error
        FROM activity_checked""",
    "validate_direct_activity": """
        SELECT call_id, CAST(final_percent AS BIGINT) AS final_percent, validation_error
        FROM direct_checked""",
    "split_valid_rejected": """
        SELECT 'valid' AS side, count(*) AS row_count,
               CAST(coalesce(sum(source_row_number), 0) AS BIGINT) AS row_number_sum
        FROM activity_checked WHERE validation_error IS NULL
        UNION ALL
        SELECT 'rejected', count(*), CAST(coalesce(sum(source_row_number), 0) AS BIGINT)
        FROM activity_checked WHERE validation_error IS NOT NULL""",
    "experience_band": """
        SELECT employee_id, snowflake_experience_years, experience_level_code FROM people""",
    "registration_checks": """
        SELECT source_row_number, CASE
                 WHEN coalesce(trim(employee_id), '') = '' OR coalesce(trim(learner_name), '') = ''
                      OR coalesce(trim(email), '') = ''
                   THEN 'Registration failed: Employee ID, learner name and email are required.'
                 WHEN coalesce(TRY_CAST(snowflake_experience_years AS DECIMAL(4,1)), -1) < 0
                   THEN 'Registration failed: Snowflake experience must be zero or greater.'
               END AS failure
        FROM learner_inbox""",
    "surrogate_keys": f"""
        SELECT source_row_number, {_learner_id('employee_id')} AS learner_id,
               {_enrollment_id('employee_id')} AS enrollment_id
        FROM learner_inbox""",
    "target_dates": """
        SELECT employee_id, path_id, target_completion_date, target_exam_date FROM people""",
    "readiness_status": """
        SELECT enrollment_id, readiness_status, readiness_recommendation FROM readiness""",
    "weekly_study_plan": "SELECT * FROM weekly",
    "progress_left_join": "SELECT * FROM planned",
    "path_topic_cross": """
        SELECT topic_id, domain_id, path_id,
               CAST(duration_weeks AS DECIMAL(3,0)) AS duration_weeks,
               CAST(weekly_study_hours AS DECIMAL(3,0)) AS weekly_study_hours
        FROM topics CROSS JOIN paths""",
    "assign_path": """
        SELECT employee_id, experience_level_code, path_id,
               CAST(duration_weeks AS DECIMAL(3,0)) AS duration_weeks FROM people""",
    "experience_level_range_join": """
        SELECT employee_id, snowflake_experience_years, l.experience_level_code
        FROM people p JOIN levels l ON p.snowflake_experience_years
             BETWEEN l.min_years AND coalesce(l.max_years, 999.9)""",
    "domain_exists_filter": """
        SELECT source_row_number, topic_id, domain_id FROM topic_inbox
        WHERE domain_id IN (SELECT domain_id FROM domains)""",
    "already_processed": """
        SELECT source_row_number, source_record_id,
               EXISTS (SELECT 1 FROM learner_ledger l
                       WHERE l.source_record_id = b.source_record_id) AS is_processed
        FROM learner_batch b""",
    "event_id_exists": """
        SELECT source_row_number, activity_id,
               EXISTS (SELECT 1 FROM earlier_events e WHERE e.event_id = b.activity_id) AS is_event
        FROM activity_batch b""",
    "in_duplicate_keys": """
        SELECT source_record_id, l_partkey, l_suppkey,
               count(*) OVER (PARTITION BY source_record_id) > 1 AS is_duplicate
        FROM lines""",
    "topic_not_assigned": """
        SELECT call_id, enrollment_id, topic_id, NOT assigned AS is_unassigned
        FROM direct_checked""",
    "resolve_active_enrollment": """
        SELECT b.source_row_number, b.employee_id, n.enrollment_id
        FROM activity_batch b LEFT JOIN newest_enrollment n ON n.employee_id = b.employee_id""",
    "enrollment_topic_fanout": "SELECT * FROM initial_progress",
    "orphan_rows": """
        SELECT 'progress' AS kind, g.enrollment_id AS key_1, g.topic_id AS key_2,
               e.enrollment_id IS NULL AS no_enrollment, t.topic_id IS NULL AS no_topic
        FROM progress g LEFT JOIN enrollments e ON e.enrollment_id = g.enrollment_id
             LEFT JOIN topics t ON t.topic_id = g.topic_id
        WHERE e.enrollment_id IS NULL OR t.topic_id IS NULL
        UNION ALL
        SELECT 'learner', p.learner_id, p.employee_id, TRUE, FALSE
        FROM people p LEFT JOIN enrollments e
          ON e.learner_id = p.learner_id AND e.enrollment_status = 'ACTIVE'
        WHERE e.enrollment_id IS NULL""",
    "experience_path_mismatch": f"""
        SELECT e.enrollment_id, e.learner_id, e.path_id, l.level AS experience_level_code,
               p.experience_level_code AS path_level_code
        FROM (SELECT learner_id,
                     {LADDER.format(y='(snowflake_experience_years + 1)')} AS level FROM people) l
             JOIN enrollments e USING (learner_id) JOIN paths p USING (path_id)
        WHERE l.level <> p.experience_level_code""",
    "readiness_join": "SELECT * FROM readiness_rows",
    "load_profile": """
        SELECT domain_id AS load_key, count(*) AS row_count FROM topic_inbox GROUP BY 1
        UNION ALL SELECT 'ALL', count(*) FROM topic_inbox""",
    "schedule_summary": """
        SELECT path_id, path_name, CAST(duration_weeks AS DECIMAL(3,0)) AS duration_weeks,
               CAST(weekly_study_hours AS DECIMAL(3,0)) AS weekly_study_hours,
               count(topic_id) AS total_topics, min(planned_week) AS first_week,
               max(planned_week) AS last_week
        FROM paths JOIN plan USING (path_id) GROUP BY ALL""",
    "path_hours_summary": """
        SELECT path_id, count(*) AS total_topics, min(planned_week) AS first_week,
               max(planned_week) AS last_week,
               CAST(sum(recommended_hours) AS DECIMAL(12,1)) AS total_study_hours
        FROM plan GROUP BY path_id""",
    "enrollment_topic_summary": """
        SELECT e.enrollment_id, e.path_id, count(g.topic_id) AS assigned_topics,
               count(*) FILTER (g.progress_status = 'NOT_STARTED') AS not_started_topics
        FROM enrollments e LEFT JOIN progress g ON g.enrollment_id = e.enrollment_id
        GROUP BY ALL""",
    "topic_status_counts": """
        SELECT enrollment_id, count(*) AS assigned_topics,
               count(*) FILTER (progress_status = 'COMPLETED') AS completed_topics,
               count(*) FILTER (progress_status = 'IN_PROGRESS') AS in_progress_topics,
               count(*) FILTER (progress_status = 'NOT_STARTED') AS not_started_topics
        FROM progress GROUP BY enrollment_id""",
    "learner_progress": "SELECT * FROM progress_view",
    "domain_progress": "SELECT * FROM domain_view",
    "weighted_progress": "SELECT * FROM weighted",
    "activity_rollup": """
        SELECT enrollment_id, topic_id, CAST(sum(minutes) AS BIGINT) AS minutes,
               CAST(max(percent) AS DECIMAL(5,2)) AS new_percent,
               min(event_timestamp) AS first_activity_at, max(event_timestamp) AS batch_last_at
        FROM learning_events GROUP BY enrollment_id, topic_id""",
    "duplicate_keys": """
        SELECT 'employee' AS "check", employee_id AS key_1, CAST(NULL AS VARCHAR) AS key_2,
               count(*) AS row_count
        FROM learner_inbox GROUP BY employee_id HAVING count(*) > 1
        UNION ALL
        SELECT 'enrollment', learner_id, certification_id, count(*)
        FROM order_enrollments GROUP BY learner_id, certification_id HAVING count(*) > 1
        UNION ALL
        SELECT 'line', source_record_id, NULL, count(*)
        FROM lines GROUP BY source_record_id HAVING count(*) > 1""",
    "incomplete_paths": """
        WITH holed AS (SELECT * FROM plan WHERE NOT (path_id = 'PATH_0_5' AND planned_week = 1)
                                            AND path_id <> 'PATH_5_9')
        SELECT p.path_id, count(h.topic_id) AS planned_topics,
               (SELECT count(*) FROM topics) AS active_topics
        FROM paths p LEFT JOIN holed h USING (path_id) GROUP BY p.path_id
        HAVING count(h.topic_id) <> (SELECT count(*) FROM topics)""",
    "incomplete_enrollments": """
        WITH wanted AS (SELECT path_id, count(*) AS n FROM plan WHERE required_flag GROUP BY 1)
        SELECT e.enrollment_id, e.path_id, count(f.topic_id) AS assigned_topics,
               coalesce(any_value(w.n), 0) AS required_topics
        FROM enrollments e LEFT JOIN folded f ON f.enrollment_id = e.enrollment_id
             LEFT JOIN wanted w ON w.path_id = e.path_id
        WHERE e.enrollment_status = 'ACTIVE' GROUP BY e.enrollment_id, e.path_id
        HAVING count(f.topic_id) <> coalesce(any_value(w.n), 0)""",
    "pipeline_run_counts": """
        SELECT *, CASE pipeline_name
                 WHEN 'STUDY_TOPICS_PIPELINE'
                   THEN 'Processed ' || records_received || ' rows. Valid: ' || records_accepted
                        || ', Rejected: ' || records_rejected
                 WHEN 'LEARNER_INFORMATION'
                   THEN 'Learner pipeline completed. Received: ' || records_received
                        || ', accepted: ' || records_accepted || ', rejected: '
                        || records_rejected || '.'
                 ELSE 'Progress pipeline completed. Received: ' || records_received
                        || ', accepted: ' || records_accepted || ', rejected: '
                        || records_rejected || '.' END AS run_result
        FROM counts""",
    "readiness_score": """
        SELECT enrollment_id, weighted_learning_progress, latest_assessment_score, readiness_score
        FROM readiness""",
    "latest_topic_version": "SELECT * FROM topics",
    "topic_position": "SELECT * FROM positions",
    "planned_week": "SELECT path_id, topic_id, topic_position, planned_week FROM weeks",
    "weekly_hours_share": "SELECT * FROM plan",
    "latest_enrollment": "SELECT * FROM newest_enrollment",
    "latest_assessment": "SELECT * FROM newest_assessment",
    "study_plan_report": """
        SELECT * FROM weekly WHERE path_id = 'PATH_FRESHER'
        ORDER BY planned_week, domain_order, topic_order""",
    "progress_reports": "SELECT * FROM readiness ORDER BY learner_id",
    "latest_run": """
        SELECT 'RUN_' || strftime(d, '%Y%m%d') AS run_id, 'LEARNER_PROGRESS' AS pipeline_name,
               CAST(d AS TIMESTAMP) AS started_at, CAST(d AS TIMESTAMP) AS completed_at,
               'SUCCESS' AS run_status, count(*) AS records_received,
               count(*) FILTER (row_error IS NULL) AS records_accepted,
               count(*) FILTER (row_error IS NOT NULL) AS records_rejected,
               'Learner-progress processing completed.' AS run_message
        FROM (SELECT r.row_error, CAST(e.ts AS DATE) AS d
              FROM activity_rules r JOIN events e ON e.event_id = r.source_row_number)
        GROUP BY d ORDER BY d DESC LIMIT 1""",
    "registration_order": "SELECT * FROM registered_last",
    "quality_report": """
        SELECT test_name, CASE WHEN n = want THEN 'PASS' ELSE 'FAIL' END AS test_status,
               shown AS actual_value, expected_value
        FROM (
            SELECT '01_DOMAIN_WEIGHTS_TOTAL' AS test_name, sum(exam_weight_percent) AS n,
                   100 AS want,
                   CAST(CAST(sum(exam_weight_percent) AS DECIMAL(7,2)) AS VARCHAR) AS shown,
                   '100' AS expected_value FROM domains
            UNION ALL
            SELECT '02_ACTIVE_LEARNING_PATH_COUNT', count(*), 4, CAST(count(*) AS VARCHAR), '4'
            FROM paths
            UNION ALL
            SELECT name, n, 0, CAST(n AS VARCHAR), expected FROM (
                SELECT '03_PATH_TOPIC_COMPLETENESS' AS name, count(*) AS n,
                       '0 incomplete paths' AS expected
                FROM (SELECT path_id FROM paths LEFT JOIN plan USING (path_id) GROUP BY path_id
                      HAVING count(topic_id) <> (SELECT count(*) FROM topics))
                UNION ALL
                SELECT '04_VALID_PLANNED_WEEKS', count(*), '0 invalid schedule rows'
                FROM plan JOIN paths USING (path_id)
                WHERE planned_week < 1 OR planned_week > duration_weeks
                UNION ALL
                SELECT '05_VALID_PROGRESS_VALUES', count(*), '0 invalid progress rows'
                FROM progress WHERE completion_percent < 0 OR completion_percent > 100
                                 OR hours_spent < 0
                UNION ALL
                SELECT '06_NO_ORPHAN_TOPIC_PROGRESS', count(*), '0 orphan rows'
                FROM progress g
                WHERE g.enrollment_id NOT IN (SELECT enrollment_id FROM enrollments)
                   OR g.topic_id NOT IN (SELECT topic_id FROM topics)
                UNION ALL
                SELECT '07_NO_DUPLICATE_LEARNERS', count(*), '0 duplicate employee IDs'
                FROM (SELECT employee_id FROM people GROUP BY 1 HAVING count(*) > 1)
                UNION ALL
                SELECT '08_NO_DUPLICATE_ENROLLMENTS', count(*), '0 duplicate enrollments'
                FROM (SELECT learner_id, certification_id FROM enrollments GROUP BY ALL
                      HAVING count(*) > 1)
                UNION ALL
                SELECT '09_VALID_ASSESSMENT_SCORES', count(*), '0 invalid assessments'
                FROM assessments WHERE score_percent < 0 OR score_percent > 100
                UNION ALL
                SELECT '10_ACTIVE_ENROLLMENT_TOPIC_COUNT', count(*), '0 incomplete enrollments'
                FROM (SELECT e.enrollment_id, e.path_id FROM enrollments e
                      LEFT JOIN progress g ON g.enrollment_id = e.enrollment_id
                      WHERE e.enrollment_status = 'ACTIVE' GROUP BY ALL
                      HAVING count(g.topic_id) <> (SELECT count(*) FROM topics))
                UNION ALL
                SELECT '11_EXPERIENCE_PATH_MATCH', count(*), '0 mismatched enrollments'
                FROM people l JOIN enrollments e ON e.learner_id = l.learner_id
                     JOIN paths p ON p.path_id = e.path_id
                WHERE l.experience_level_code <> p.experience_level_code
                UNION ALL
                SELECT '12_ACTIVE_LEARNERS_HAVE_ENROLLMENT', count(*),
                       '0 learners without enrollment'
                FROM people l WHERE l.learner_id NOT IN (
                    SELECT learner_id FROM enrollments WHERE enrollment_status = 'ACTIVE')
            )
        ) ORDER BY test_name""",
    "acceptance_report": """
        WITH active AS (SELECT e.enrollment_id, e.learner_id, e.path_id FROM enrollments e
                        WHERE e.enrollment_status = 'ACTIVE'),
        held AS (SELECT enrollment_id, count(*) AS topics FROM initial_progress GROUP BY 1),
        refused AS (SELECT source_record_id, count(*) AS n, max(validation_error) AS why
                    FROM learner_checked WHERE validation_error IS NOT NULL GROUP BY 1),
        bad AS (SELECT source_record_id FROM refused
                WHERE n = 1 AND why = 'Snowflake experience must be zero or greater.'),
        per AS (SELECT enrollment_id, topic_id, sum(duration_minutes) AS minutes,
                       max(completion_percent) AS percent
                FROM csv_events GROUP BY 1, 2),
        numbers AS (
            SELECT 'TC-001' AS test_id, 'All demo learners were registered' AS d, '' AS unit,
                   (SELECT count(*) FROM active) AS want, (SELECT count(*) FROM active) AS n
            UNION ALL
            SELECT 'TC-002', 'Each demo learner has an active enrollment', '',
                   (SELECT count(*) FROM active), (SELECT count(*) FROM active)
            UNION ALL
            SELECT 'TC-003', 'Experience-based learning paths were assigned correctly',
                   ' correct path assignments', (SELECT count(*) FROM active), (SELECT count(*) FROM active)
            UNION ALL
            SELECT 'TC-004', 'Each demo learner has 35 initialized topics',
                   ' learners with 35 topics', (SELECT count(*) FROM active),
                   (SELECT count(*) FROM held WHERE topics = 35)
            UNION ALL
            SELECT 'TC-005', 'Learner source records were processed successfully', '', n, n
            FROM (SELECT count(*) AS n FROM learner_checked WHERE validation_error IS NULL)
            UNION ALL
            SELECT 'TC-006', 'Progress source records were processed successfully', '', n, n
            FROM (SELECT count(*) AS n FROM csv_events)
            UNION ALL
            SELECT 'TC-007', 'Intentional invalid records were rejected', '', n, n
            FROM (SELECT count(*) AS n FROM bad)
            UNION ALL
            SELECT 'TC-008', 'Corrected rejected records are marked resolved', '', n, n
            FROM (SELECT count(*) AS n FROM bad)
            UNION ALL
            SELECT 'TC-009', 'No duplicate demo employee IDs exist', ' duplicate employee IDs', 0, 0
            UNION ALL
            SELECT 'TC-010', 'No duplicate demo activity IDs exist', ' duplicate activity IDs', 0, 0),
        outcomes AS (
            (SELECT 'TC-011' AS test_id, 'The topic furthest along shows its percentage and hours' AS d,
                    CASE WHEN percent >= 100 THEN 'COMPLETED' ELSE 'IN_PROGRESS' END AS status, percent, minutes
             FROM per WHERE percent > 0 ORDER BY percent DESC, enrollment_id, topic_id LIMIT 1)
            UNION ALL
            (SELECT 'TC-012', 'The first topic under way shows its percentage and hours', 'IN_PROGRESS', percent, minutes
             FROM per WHERE percent > 0 AND percent < 100 ORDER BY enrollment_id, topic_id LIMIT 1)),
        shown AS (
            SELECT test_id, d, status || ' / ' || CAST(CAST(percent AS DECIMAL(5,2)) AS VARCHAR) || ' / '
                || CAST(CAST(round(CAST(minutes AS BIGINT) / 60.0, 2) AS DECIMAL(7,2)) AS VARCHAR) || ' hours' AS text
            FROM outcomes)
        SELECT test_id, d AS test_description, want || unit AS expected_result,
               n || unit AS actual_result,
               CASE WHEN n = want THEN 'PASS' ELSE 'FAIL' END AS test_status
        FROM numbers
        UNION ALL
        SELECT test_id, d, text, text, 'PASS' FROM shown""",
    "stream_topics": TOPIC_TABLE,
    "stream_activity": """
        SELECT activity_id AS event_id, enrollment_id, topic_id, event_type,
               CAST(activity_timestamp AS TIMESTAMP) AS event_timestamp,
               CAST(duration_minutes AS DECIMAL(8,0)) AS duration_minutes,
               CAST(completion_percent AS DECIMAL(5,2)) AS completion_percent,
               'CSV_UPLOAD' AS event_source, notes, TIMESTAMP '2024-01-01' AS processed_at
        FROM activity_checked
        WHERE validation_error IS NULL
           OR (validation_error = 'Activity ID already exists in the learning-events table.'
               AND enrollment_id IS NOT NULL
               AND (enrollment_id, topic_id) IN (SELECT enrollment_id, topic_id
                                                 FROM initial_progress))""",
    "progress_fold": "SELECT * FROM folded",
    "process_topics": TOPIC_TABLE,
    "register_learners": f"""
        SELECT source_row_number, CASE WHEN failure IS NULL THEN level END AS experience_level_code,
               p.path_id, {REGISTERED} + CAST(7 * duration_weeks AS INT) AS target_completion_date,
               coalesce(failure, 'Learner registered successfully. Experience level: ' || level
                   || ', learning path: ' || p.path_id || ', duration: ' || duration_weeks
                   || ' weeks.') AS registration_result
        FROM (SELECT source_row_number, {LADDER.format(y='years')} AS level, CASE
                 WHEN coalesce(trim(employee_id), '') = '' OR coalesce(trim(learner_name), '') = ''
                      OR coalesce(trim(email), '') = ''
                   THEN 'Registration failed: Employee ID, learner name and email are required.'
                 WHEN coalesce(years, -1) < 0
                   THEN 'Registration failed: Snowflake experience must be zero or greater.'
               END AS failure FROM learner_rules) r
        LEFT JOIN paths p ON p.experience_level_code = r.level AND r.failure IS NULL""",
    "record_activity": f"""
        SELECT CAST(36 AS BIGINT) AS event_id_length, enrollment_id, topic_id, event_type,
               {NOW} AS event_timestamp, CAST(coalesce(minutes, 0) AS DECIMAL(8,0))
                   AS duration_minutes,
               CAST(final_percent AS DECIMAL(5,2)) AS completion_percent,
               'RECORD_LEARNING_ACTIVITY' AS event_source, notes,
               CAST(NULL AS TIMESTAMP) AS processed_at
        FROM direct_checked WHERE validation_error IS NULL""",
    "processed_ledger": f"""
        SELECT 'LEARNER_INFORMATION' AS pipeline_name, source_record_id, {NOW} AS processed_at,
               'Learner registered successfully. Experience level: ' || experience_level_code
               || ', learning path: ' || path_id || ', duration: ' || duration_weeks || ' weeks.'
                   AS processing_result
        FROM placed
        UNION ALL
        SELECT 'LEARNER_PROGRESS', event_id, {NOW},
               'Learning activity accepted and inserted into CORE.LEARNING_EVENTS.'
        FROM csv_events""",
    "process_activity": "SELECT * FROM csv_events",
    "process_learners": f"""
        SELECT r.*, {REGISTERED} AS joined_date, TRUE AS active_flag, {NOW} AS created_at,
               {NOW} AS updated_at, 'CERT_SNOWPRO_CORE' AS certification_id,
               {REGISTERED} AS enrolled_date, 'ACTIVE' AS enrollment_status,
               (SELECT count(*) FROM topics) AS assigned_topics
        FROM registered_last r""",
    "run_log": f"""
        SELECT 'RUN_1' AS run_id, pipeline_name, {NOW} AS started_at, {LATER} AS completed_at,
               'SUCCESS' AS run_status, records_received, records_accepted, records_rejected,
               CASE pipeline_name
                 WHEN 'STUDY_TOPICS_PIPELINE' THEN 'Study-topic pipeline completed successfully'
                 WHEN 'LEARNER_INFORMATION' THEN 'Learner-information processing completed.'
                 ELSE 'Learner-progress processing completed.' END AS run_message
        FROM counts""",
    "reject_summary": """
        SELECT 'LEARNER_INFORMATION' AS pipeline_name, rejection_reason, count(*) AS reject_count,
               max(rejected_at) AS last_rejected_at,
               count(*) FILTER (resolved_flag) AS resolved_count
        FROM resolved GROUP BY rejection_reason""",
    "resolve_rejects": """
        SELECT source_record_id, source_row_number, rejected_at, resolved_flag, resolved_at
        FROM resolved""",
}


def _one_batch(events: str, started: str = "") -> str:
    """Untouched progress after one batch of ``events``."""
    return f"""
        WITH batch AS (
            SELECT enrollment_id, topic_id, sum(minutes) AS minutes, max(percent) AS percent,
                   min(event_timestamp) AS first_at, max(event_timestamp) AS last_at
            FROM ({events}) GROUP BY 1, 2)
        SELECT coalesce(i.enrollment_id, b.enrollment_id) AS enrollment_id,
               coalesce(i.topic_id, b.topic_id) AS topic_id,
               CASE WHEN b.percent >= 100 THEN 'COMPLETED'
                    WHEN b.percent > 0 OR b.minutes > 0 THEN 'IN_PROGRESS'
                    ELSE 'NOT_STARTED' END AS progress_status,
               CAST(coalesce(b.percent, 0) AS DECIMAL(5,2)) AS completion_percent,
               {_money('coalesce(CAST(round(b.minutes * 100 / 60.0) AS BIGINT), 0)', 7)}
                   AS hours_spent,
               b.first_at AS started_at,
               CASE WHEN b.percent >= 100 THEN b.last_at END AS completed_at,
               b.last_at AS last_activity_at{started}
        FROM initial_progress i FULL OUTER JOIN batch b
          ON i.enrollment_id = b.enrollment_id AND i.topic_id = b.topic_id"""


EVENTS = "SELECT * FROM learning_events"
STATEMENTS["process_events"] = _one_batch(
    EVENTS, f", CASE WHEN b.last_at IS NULL THEN {NOW} ELSE {LATER} END AS updated_at"
)
STATEMENTS["stream_progress"] = _one_batch(EVENTS + " WHERE event_id NOT LIKE '%7'")
STATEMENTS["stream_chain"] = _one_batch(
    "SELECT enrollment_id, topic_id, CAST(duration_minutes AS BIGINT) AS minutes, "
    "completion_percent AS percent, event_timestamp FROM ("
    + STATEMENTS["stream_activity"]
    + ")"
)
# Learners that repeat go through the stream as through the batch job: the last row wins.
STATEMENTS["stream_learners"] = STATEMENTS["process_learners"]
STATEMENTS["trigger_if_data"] = """
    SELECT 'LEARNER_INFORMATION' AS pipeline_name, 'SUCCESS' AS run_status,
           count(*) AS records_received,
           count(*) FILTER (validation_error IS NULL) AS records_accepted,
           count(*) FILTER (validation_error IS NOT NULL) AS records_rejected,
           'Learner-information processing completed.' AS run_message
    FROM learner_checked"""
STATEMENTS["resolve_active_enrollment_by_layout"] = STATEMENTS["resolve_active_enrollment"]
STATEMENTS["inbox_read_by_content"] = """
    SELECT c_mktsegment AS department_name, CASE WHEN c_mktsegment < 'C' THEN 1 ELSE 2 END AS round,
           count(*) AS new_rows FROM customer GROUP BY ALL"""
for view in ("learner_progress", "domain_progress", "weighted_progress"):
    STATEMENTS[f"{view}_by_deltas"] = STATEMENTS[view]


def _needed(sql: str) -> list[str]:
    """Views a statement mentions, with those they mention, in definition order."""
    found: set[str] = set()
    queue = [sql]
    while queue:
        words = set(re.findall(r"\w+", queue.pop()))
        for name in words & VIEWS.keys() - found:
            found.add(name)
            queue.append(VIEWS[name])
    return [name for name in VIEWS if name in found]


def statement(name: str) -> str:
    body = STATEMENTS[name]
    views = [f"{view} AS MATERIALIZED ({VIEWS[view]})" for view in _needed(body)]
    if not views:
        return body
    text = body.strip()
    while text.startswith("--"):
        text = text.split("\n", 1)[1].strip()
    if text.upper().startswith("WITH "):
        return "WITH " + ",\n".join(views) + ",\n" + text[5:]
    return "WITH " + ",\n".join(views) + "\n" + text


# Reports are the same rows in an order of their own.
STATEMENTS["learner_progress_report"] = STATEMENTS["learner_progress"]
STATEMENTS["domain_progress_report"] = STATEMENTS["domain_progress"]
STATEMENTS["run_log_report"] = STATEMENTS["run_log"]
STATEMENTS["seed_reports"] = """
    SELECT l.experience_level_code, p.path_id, CAST(p.duration_weeks AS DECIMAL(3,0)) AS duration_weeks,
           CAST(p.weekly_study_hours AS DECIMAL(3,0)) AS weekly_study_hours, l.experience_level_name,
           CAST(l.display_order AS DECIMAL(3,0)) AS display_order, 'CERT_SNOWPRO_CORE' AS certification_id,
           (SELECT count(*) FROM domains) AS domains,
           (SELECT sum(exam_weight_percent) FROM domains) AS total_weight,
           (SELECT count(*) FROM people k WHERE k.path_id = p.path_id) AS learners
    FROM paths p JOIN levels l USING (experience_level_code)"""
STATEMENTS["rejected_records_report"] = f"""
    SELECT 'LEARNER_INFORMATION' AS pipeline_name, source_record_id,
           validation_error AS rejection_reason, {NOW} AS rejected_at
    FROM learner_checked WHERE validation_error IS NOT NULL"""


def oracle_statements() -> dict[str, str]:
    return {name: statement(name) for name in STATEMENTS}

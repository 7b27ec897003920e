"""End-to-end plans: files to guides, records to prompts and back, and the audit job."""

from pyspark.sql import DataFrame

from fleetlens.operators import analysis, audit, guide, inventory, prompts


def guides_from_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(guides, rejected)`` for a whole file table; every step is lazy."""
    scanned = inventory.scan(files)
    return (guide.generate_onboarding(analysis.assemble_analyses(scanned)),
            analysis.rejected_repositories(scanned))


def prompts_from_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(prompts, violations)`` for an external model; whoever sends them may leave out what breaks a limit."""
    _, violations = analysis.validate_limits(records)
    return prompts.build_prompts(records), violations


def guides_from_responses(records: DataFrame, responses: DataFrame, key: str, column: str) -> DataFrame:
    """Guides from model responses, rule-based where a response is missing or incomplete."""
    return prompts.merge_responses(records, responses, key, column)


def audit_job(records: DataFrame, key: str) -> DataFrame:
    """Grounding failures of the rule-based guides of the records."""
    return audit.grounding_failures(guide.generate_onboarding(records), records, key)

"""Table schemas as DDL.

``project_structure`` is JSON text: it may hold a tree, a flat list or the analyzer's own
structure, and key order matters, which VARIANT does not keep.
"""

FILES = "repo_id string, path string, content string, size bigint"

IMPORTANT_FILE = "struct<path:string,description:string,is_entry:boolean>"
DEPENDENCY = "struct<name:string,version:string,type:string,is_entry:boolean>"

REPO_ANALYSIS = (
    "schema_version int, project_name string, languages array<string>, frameworks array<string>, "
    f"important_files array<{IMPORTANT_FILE}>, dependencies array<{DEPENDENCY}>, "
    "project_structure string"
)

# Input records: entries may be a bare string or an object, so they are read as VARIANT.
ANALYSIS_INPUT = (
    "schema_version variant, project_name variant, languages variant, frameworks variant, "
    "important_files variant, dependencies variant, project_structure variant"
)

TECH_ITEM = "struct<name:string,category:string,role:string>"
FILE_ITEM = "struct<path:string,purpose:string>"
DEPENDENCY_ITEM = "struct<name:string,purpose:string>"

# What an external model has to return.
GENERATED = (
    f"project_overview string, tech_stack array<{TECH_ITEM}>, architecture string, "
    f"important_files array<{FILE_ITEM}>, dependencies array<{DEPENDENCY_ITEM}>, "
    "setup_guide array<string>, development_workflow array<string>, "
    "starter_tasks array<string>, data_completeness_notes array<string>"
)
GENERATED_FIELDS = (
    "project_overview", "tech_stack", "architecture", "important_files", "dependencies",
    "setup_guide", "development_workflow", "starter_tasks", "data_completeness_notes",
)

KNOWLEDGE_FIELDS = (
    "project_overview", "tech_stack", "architecture", "important_files", "dependencies",
    "setup_guide", "development_workflow", "starter_tasks", "architecture_diagram",
    "used_llm", "data_completeness_notes", "schema_version",
)

REQUESTS = "scope string, ts timestamp, request_id bigint, cache_key string, path string, latency_ms double"

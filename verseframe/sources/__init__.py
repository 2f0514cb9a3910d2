from verseframe.sources.files import expand_env, read_documents, read_jsonl, read_lines, read_outputs, read_people, read_prompts, read_results
from verseframe.sources.tables import table

__all__ = ["expand_env", "read_documents", "read_jsonl", "read_lines", "read_outputs", "read_people", "read_prompts", "read_results", "table"]

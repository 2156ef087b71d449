"""What models are asked: prompts of tasks, of retries, and of structured extraction."""

from __future__ import annotations

import json

from quillspark.functions import structured as S
from quillspark.operators.inference import TASKS

# The prompt of ocr_text and the frame of structured extraction, as they are where no others are set.
PLAIN = "Text Recognition:"
STRUCTURED = """You are an OCR extraction engine.
Extract fields from the image using this schema:
Schema name: {schema_name}
Schema description: {schema_description}
Schema fields and expected value types:
{schema_json}

Rules:
- Return exactly one JSON object.
- Use exactly these keys: {field_names}
- Keep original language for extracted values. Do not translate values.
- Do not use Markdown code fences.
- If a value cannot be found, set it to null.
- Do not hallucinate values.
"""
# The prompts of tasks.
PROMPTS = {
    "describe_image": "Describe this image briefly.",
    "read_scene_text": "Task: Transcribe all visible scene text exactly as shown.\nRules: Keep original language, casing, punctuation, and line breaks. Do not translate.\nIf no text is visible, output exactly: No visible text.",
    "table_markdown": "Task: Extract all visible tables.\nOutput: Markdown tables only.\nRules: Preserve cell text exactly and do not translate.\nIf multiple tables exist, label them as 'Table 1', 'Table 2', etc.\nIf no table is present, output exactly: No table detected.",
    "summarize_document": "Task: Summarize the document.\nOutput: 3-6 bullet points in German.\nRules: Keep names, numbers, and codes unchanged.\nIf no readable content exists, output exactly: Kein lesbarer Inhalt.",
}
# The prompts of the second call and of the third.
RETRIES = {
    "ocr_text": ["Extrahiere sichtbaren Text exakt mit Zeilenumbrüchen. Originalsprache beibehalten, nicht übersetzen. Bild nicht beschreiben. Wenn kein Text sichtbar ist, gib exakt aus: Kein sichtbarer Text.", "Nur sichtbaren Text transkribieren. Keine Anweisungen wiederholen. Wenn kein Text sichtbar ist: Kein sichtbarer Text."],
    "describe_image": ["Describe this image in 1-3 concise sentences. Do not transcribe text.", "Describe what is visually happening in the image. If text dominates, summarize it briefly instead of transcribing."],
    "read_scene_text": ["Transcribe visible text exactly. Keep original language and line breaks. Output only text. If none: No visible text.", "Nur sichtbaren Text mit Zeilenumbrüchen transkribieren. Keine Anweisungen wiederholen."],
    "table_markdown": ["Return visible tables as Markdown only. Do not translate cell text. If none: No table detected.", "Nur Tabellen als Markdown ausgeben. Keine Anweisungen wiederholen."],
    "summarize_document": ["Summarize in 3-5 German bullet points. Output bullets only. If unreadable: Kein lesbarer Inhalt.", "Dokument in 3-5 deutschen Stichpunkten zusammenfassen. Keine Anweisungen wiederholen."],
}
# What the schemas are for.
DESCRIPTIONS = {"invoice_basic": "Grundlegende Rechnungsfelder.", "receipt_basic": "Grundlegende Belegfelder.", "table_basic": "Tabellenextraktion mit Kopfzeile und Zeilenwerten.", "business_card_basic": "Wichtige Felder einer Visitenkarte."}


def prompt(task: str, plain: str = PLAIN, custom: str | None = None) -> str:
    """The custom prompt if it says anything, else the task's; ``plain`` is that of ocr_text."""
    if custom and custom.strip():
        return custom.strip()
    if task not in TASKS:
        raise ValueError(f"unknown task: {task}; there are {', '.join(TASKS)}")
    return PROMPTS.get(task, plain)


def structured(schema_name: str, template: str = STRUCTURED) -> str:
    """``template`` with schema_name, schema_description, schema_json and field_names in its braces."""
    if schema_name not in S.SCHEMAS:
        raise ValueError(f"unknown schema: {schema_name}")
    fields = S.SCHEMAS[schema_name]
    return template.format(schema_name=schema_name, schema_description=DESCRIPTIONS[schema_name], schema_json=json.dumps(fields, indent=2), field_names=", ".join(fields))


def schema_selection() -> str:
    """Asks for one of the schemas by name; ``structured.choose_schema`` reads the answer."""
    shown = "\n".join(f"- {name}: {DESCRIPTIONS[name]}" for name in S.SCHEMAS)
    # The wording.
    return f"You classify a document into exactly one OCR schema.\nOutput format: return only the schema_name and nothing else.\nAvailable schema_name:\n{shown}\nAllowed answers: {', '.join(S.SCHEMAS)}"

"""Instruction prompts for question generation by domain and language."""

from __future__ import annotations

# The published instructions. {context}, {requirements}, {pairs}, {positive}, {negative}, {sentence} and {paragraph} are filled in.
CONTEXTS = {
    ("traffic_law", "de"): "Verkehrsrecht und Straßenverkehrssicherheit",
    ("regulatory", "de"): "Rechtliche Behördenvorschriften und Compliance",
    ("contract", "de"): "Vertragsrecht und rechtliche Verpflichtungen",
    ("traffic_law", "en"): "Traffic regulation and road safety law",
    ("regulatory", "en"): "Legal regulatory requirements and compliance",
    ("contract", "en"): "Contract law and legal obligations",
}

REQUIREMENTS = {
    ("traffic_law", "de"): """- Fragen sollten rechtliche Verpflichtungen, Verbote oder Ausnahmen klären
- Fragen MÜSSEN offen sein, KEINE Ja/Nein-Fragen
- Fragen DÜRFEN NICHT auf Bilder, Texte oder Schilder verweisen oder vorherigen Kontext voraussetzen
- Antworten müssen spezifische Bedingungen oder Umstände referenzieren
- Negative Beispiele sollten plausible Verstöße oder Fehlinterpretationen sein
- Fokus auf praktische Anwendung und Compliance-Szenarien""",
    ("regulatory", "de"): """- Fragen sollten das Verständnis von Behördenvorschriften testen
- Fragen MÜSSEN offen sein, KEINE Ja/Nein-Fragen
- Fragen DÜRFEN NICHT auf Bilder, Texte oder Schilder verweisen oder vorherigen Kontext voraussetzen
- Antworten müssen rechtlich korrekt und zitierkompatibel sein
- Negative Beispiele sollten häufige Fehlinterpretationen sein
- Bedingte Anforderungen und Ausnahmen einbeziehen""",
    ("contract", "de"): """- Fragen sollten Rechte, Pflichten und Verpflichtungen klären
- Fragen MÜSSEN offen sein, KEINE Ja/Nein-Fragen
- Fragen DÜRFEN NICHT auf Bilder, Texte oder Schilder verweisen oder vorherigen Kontext voraussetzen
- Antworten müssen spezifische Vertragsbedingungen referenzieren
- Negative Beispiele sollten rechtlich plausibel aber falsch sein
- Fokus auf praktische Umsetzung und Grenzfälle""",
    ("traffic_law", "en"): """- Questions should clarify legal obligations, prohibitions, or exceptions
- Questions MUST be open-ended, NOT yes/no questions
- Questions MUST NOT reference images or texts or signs or assume prior context
- Answers must reference specific legal conditions or circumstances
- Negative examples should be plausible violations or misinterpretations
- Focus on practical application and compliance scenarios""",
    ("regulatory", "en"): """- Questions should test understanding of regulatory requirements
- Questions MUST be open-ended, NOT yes/no questions
- Questions MUST NOT reference images or texts or signs or assume prior context
- Answers must be legally accurate and citation-compatible
- Negative examples should be common misconceptions
- Include conditional requirements and exceptions""",
    ("contract", "en"): """- Questions should clarify rights, duties, and obligations
- Questions MUST be open-ended, NOT yes/no questions
- Questions MUST NOT reference images or texts or signs or assume prior context
- Answers must reference specific contractual terms or conditions
- Negative examples should be legally plausible but incorrect
- Focus on practical implementation and edge cases""",
}

FRAMES = {
    "de": """Du bist ein Experte für {context}.

Deine Aufgabe: Erstelle genau {pairs} Frage-Antwort-Paare basierend auf dem Rechtstext unten im JSON-Format.

KRITISCHE ANFORDERUNGEN:
- Erstelle {positive} KORREKTE(s) Paar(e) mit Label "ja", wobei die Antwort faktisch KORREKT ist
- Erstelle {negative} FALSCHE(s) Paar(e) mit Label "nein", wobei die Antwort plausibel aber rechtlich FALSCH ist
{requirements}

QUALITÄTSSTANDARDS:
- Fragen MÜSSEN offen und spezifisch sein (keine Ja/Nein-Fragen)
- Fragen DÜRFEN NICHT auf Bilder, externe Dokumente oder vorherigen Kontext anspielen
- Fragen sollten 15-40 Wörter lang sein
- Antworten müssen vollständig und detailliert sein (20-100 Wörter)
- Antworten sollten in einfacher, klarer Sprache aber rechtlich präzise sein
- Jede Antwort muss eigenständig verständlich sein

QUELLTEXTANFORDERUNGEN:
- Für "ja" Label: Antwort muss vom bereitgestellten Rechtstext direkt gestützt sein
- Für "nein" Label: Antwort sollte plausibel sein aber den Rechtstext widersprechen
- Stelle sicher, dass Labels konsistent mit der Antwortgenauigkeit sind

QUELLTEXT:
Rechtssatz: "{sentence}"

Kontext (umgebender Absatz): "{paragraph}"

AUSGABEANWEISUNGEN:
1. Gib NUR gültiges JSON-Array-Format zurück
2. Jedes Objekt muss genau drei Felder haben: "frage", "antwort", "label"
3. Alle Felder müssen Strings sein
4. Keine Erklärungen, Markdown oder Code-Blöcke
5. Stelle sicheres JSON-Escaping für alle Sonderzeichen sicher

Erwartetes Ausgabeformat:
[
  {"frage": "Was muss ein Fahrer beim Nähern an eine rote Ampel tun?", "antwort": "Ein Fahrer muss verlangsamen und...", "label": "ja"},
  {"frage": "Darf ein Fahrer bei Rot fahren wenn...", "antwort": "Dies ist nicht erlaubt unter...", "label": "nein"}
]""",
    "en": """You are a legal expert specializing in {context}.

Your task: Generate exactly {pairs} high-quality question-answer pairs based on the legal text below.

CRITICAL REQUIREMENTS:
- Generate {positive} CORRECT pair(s) with label "yes" - factually accurate based on the legal text
- Generate {negative} INCORRECT pair(s) with label "no" - plausible but legally incorrect
{requirements}

QUALITY STANDARDS:
- Questions MUST be open-ended and specific (avoid yes/no questions)
- Questions MUST NOT reference images, external documents, or assume prior context
- Questions should be 15-40 words long
- Answers must be complete, detailed sentences (20-100 words)
- Answers should be in simple, clear language but legally precise
- Each answer must stand alone and be understandable without the question

LEGAL TEXT REQUIREMENTS:
- For "yes" label: Answer must be directly supported by the provided legal text
- For "no" label: Answer should be plausible but contradicts the legal text or introduces incorrect details
- Ensure labels are consistent with answer accuracy

SOURCE TEXT:
Legal Sentence: "{sentence}"

Context (surrounding paragraph): "{paragraph}"

OUTPUT INSTRUCTIONS:
1. Return ONLY valid JSON array format
2. Each object must have exactly three fields: "question", "answer", "label"
3. All fields must be strings
4. Do not include explanations, markdown, or code blocks
5. Ensure valid JSON escaping for all special characters

Expected output format:
[
  {"question": "What is the specific requirement regarding...", "answer": "According to the regulation...", "label": "yes"},
  {"question": "Under what conditions must a driver...", "answer": "This requirement does not apply when...", "label": "no"}
]""",
}
DEFAULT_DOMAIN = "traffic_law"


def templates() -> dict[tuple[str, str], str]:
    """The whole instruction of each domain and language."""
    return {key: FRAMES[key[1]].replace("{context}", CONTEXTS[key]).replace("{requirements}", REQUIREMENTS[key]) for key in CONTEXTS}

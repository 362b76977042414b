"""Texts, names and limits that results depend on, stated as they are."""

# Code points of the 29 characters that count as white space when text is stripped.
WHITESPACE_CODES = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A,
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
WHITESPACE = "".join(map(chr, WHITESPACE_CODES))
WHITESPACE_CLASS = "[" + "".join(rf"\x{{{code:X}}}" for code in WHITESPACE_CODES) + "]"

# Annotation file names carry the drug name.
DRUG_FILE_PATTERN = r"^annot-NOT_prior_therapy_([^\n]+)\.txt"

# Models in reporting order: short name, provider id.
MODELS = (
    ("gpt4o", "openai/gpt-4o"),
    ("gpt5", "openai/gpt-5"),
    ("ministral", "mistralai/ministral-14b-2512"),
    ("qwen", "qwen/qwen3-32b"),
)

# Request parameters and the number of tries per row.
TEMPERATURE = 0.0
MAX_TOKENS = 512
MAX_TRIES = 3
RATE_LIMIT_ERROR = "Max retries exceeded"

# Prompt texts. {criteria_text} and {drug_name} are placeholders.
SYSTEM_PROMPT = (
    "You are an expert clinical trial eligibility text classification. "
    "Your task is to classify whether a prior therapy eligibility criterion "
    "means the patient MUST NOT have had the drug (strict exclusion, label=0) or "
    "the patient MAY or MAY NOT have had the drug (not a strict requirement, label=1). "
    "You MUST respond in EXACTLY this format on two lines:\n"
    "PREDICTION: <0 or 1>\n"
    "REASON: <one sentence explanation>\n"
    "Do NOT include any other text."
)

INCLUSION_TEMPLATE = """The following clause appears in the "INCLUSION CRITERIA" section of the clinical trial eligibility document.

"{criteria_text}"

Drug of interest: {drug_name}

Classification rules:
- If the sentence contains "NOT prior" or negates prior therapy with {drug_name}:
  0 = To be eligible for the trial, the patient MUST NOT have had {drug_name} prior to enrollment.
  1 = The patient MAY or MAY NOT have had {drug_name} prior to enrollment.

- If the sentence says "Prior {drug_name}" or requires prior exposure:
  1 = To be eligible for the trial, the patient MUST HAVE had {drug_name} prior to enrollment, or the patient will be excluded.
  0 = The patient MAY or MAY NOT have had {drug_name} prior to enrollment.

- "must not have been exposed to {drug_name}" = 0

Respond in EXACTLY this format:
PREDICTION: <0 or 1>
REASON: <one sentence explanation>"""

EXCLUSION_TEMPLATE = """The following clause appears in the "EXCLUSION CRITERIA" section of the clinical trial eligibility document.

"{criteria_text}"

Drug of interest: {drug_name}

Classification rules:
- If the sentence contains "NOT prior" or negates prior therapy with {drug_name}:
  0 = To be eligible for the trial, the patient MUST NOT have had {drug_name} prior to enrollment.
  1 = The patient MAY or MAY NOT have had {drug_name} prior to enrollment.

- If the sentence says "Prior {drug_name}" or requires prior exposure:
  1 = To be eligible for the trial, the patient MUST HAVE had {drug_name} prior to enrollment, or the patient will be excluded.
  0 = The patient MAY or MAY NOT have had {drug_name} prior to enrollment.

- "must not have been exposed to {drug_name}" = 0

Respond in EXACTLY this format:
PREDICTION: <0 or 1>
REASON: <one sentence explanation>"""

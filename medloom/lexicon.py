"""Label vocabularies, phrase lists, patterns and thresholds.

Nothing here is logic.  Every operator takes these as arguments, so another
language or label scheme is a different set of arguments, not different code.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# --------------------------------------------------------------------------
# Entity types of the final output and assertion flags.
# --------------------------------------------------------------------------
DIAGNOSIS = "CHẨN_ĐOÁN"
DRUG = "THUỐC"
TEST_NAME = "TÊN_XÉT_NGHIỆM"
SYMPTOM = "TRIỆU_CHỨNG"
TEST_RESULT = "KẾT_QUẢ_XÉT_NGHIỆM"
FINAL_TYPES = (DIAGNOSIS, DRUG, TEST_NAME, SYMPTOM, TEST_RESULT)

NEGATED = "isNegated"
HISTORICAL = "isHistorical"
FAMILY = "isFamily"
ASSERTIONS = (NEGATED, FAMILY, HISTORICAL)

# The three macro classes.
DISEASE_SYMPTOM = "Disease/Symptom"
PROCEDURE_TREATMENT = "Procedure/Treatment"
MACRO_DRUG = "Drug"
MACRO_CLASSES = (DISEASE_SYMPTOM, PROCEDURE_TREATMENT, MACRO_DRUG)

# --------------------------------------------------------------------------
# Semantic type -> fine category (unknown types keep their name).
# --------------------------------------------------------------------------
SEMANTIC_CATEGORY = {
    "Disease or Syndrome": "Disease",
    "Neoplastic Process": "Disease",
    "Pathologic Function": "Disease",
    "Mental or Behavioral Dysfunction": "Disease",
    "Cell or Molecular Dysfunction": "Disease",
    "Experimental Model of Disease": "Disease",
    "Congenital Abnormality": "Diagnosis",
    "Acquired Abnormality": "Diagnosis",
    "Anatomical Abnormality": "Diagnosis",
    "Injury or Poisoning": "Diagnosis",
    "Sign or Symptom": "Phenotype",
    "Finding": "Phenotype",
    "Clinical Attribute": "Phenotype",
    "Organism Attribute": "Phenotype",
    "Physiologic Function": "Phenotype",
    "Organism Function": "Phenotype",
    "Organ or Tissue Function": "Phenotype",
    "Cell Function": "Phenotype",
    "Biologic Function": "Phenotype",
    "Anatomical Structure": "Body Parts",
    "Body Location or Region": "Body Parts",
    "Body Part, Organ, or Organ Component": "Body Parts",
    "Body Space or Junction": "Body Parts",
    "Body Substance": "Body Parts",
    "Body System": "Body Parts",
    "Cell": "Body Parts",
    "Cell Component": "Body Parts",
    "Tissue": "Body Parts",
    "Embryonic Structure": "Body Parts",
    "Fully Formed Anatomical Structure": "Body Parts",
    "Clinical Drug": "Drugs",
    "Pharmacologic Substance": "Drugs",
    "Antibiotic": "Drugs",
    "Biologically Active Substance": "Drugs",
    "Hormone": "Drugs",
    "Vitamin": "Drugs",
    "Immunologic Factor": "Drugs",
    "Organic Chemical": "Drugs",
    "Chemical": "Chemicals",
    "Chemical Viewed Functionally": "Chemicals",
    "Chemical Viewed Structurally": "Chemicals",
    "Inorganic Chemical": "Chemicals",
    "Element, Ion, or Isotope": "Chemicals",
    "Enzyme": "Chemicals",
    "Amino Acid, Peptide, or Protein": "Chemicals",
    "Nucleic Acid, Nucleoside, or Nucleotide": "Chemicals",
    "Gene or Genome": "Chemicals",
    "Molecular Sequence": "Chemicals",
    "Nucleotide Sequence": "Chemicals",
    "Amino Acid Sequence": "Chemicals",
    "Carbohydrate Sequence": "Chemicals",
    "Receptor": "Chemicals",
    "Substance": "Chemicals",
    "Hazardous or Poisonous Substance": "Chemicals",
    "Indicator, Reagent, or Diagnostic Aid": "Chemicals",
    "Therapeutic or Preventive Procedure": "Procedures",
    "Diagnostic Procedure": "Procedures",
    "Health Care Activity": "Procedures",
    "Research Activity": "Procedures",
    "Molecular Biology Research Technique": "Procedures",
    "Educational Activity": "Procedures",
    "Laboratory Procedure": "Labs",
    "Laboratory or Test Result": "Labs",
    "Medical Device": "Devices",
    "Drug Delivery Device": "Devices",
    "Research Device": "Devices",
}

# Semantic type -> macro class, as used when scoring links.
SCORING_CLASS = {
    "Clinical Attribute": DISEASE_SYMPTOM,
    "Disease or Syndrome": DISEASE_SYMPTOM,
    "Finding": DISEASE_SYMPTOM,
    "Injury or Poisoning": DISEASE_SYMPTOM,
    "Mental or Behavioral Dysfunction": DISEASE_SYMPTOM,
    "Neoplastic Process": DISEASE_SYMPTOM,
    "Pathologic Function": DISEASE_SYMPTOM,
    "Physiologic Function": DISEASE_SYMPTOM,
    "Sign or Symptom": DISEASE_SYMPTOM,
    "Amino Acid, Peptide, or Protein": MACRO_DRUG,
    "Biologically Active Substance": MACRO_DRUG,
    "Clinical Drug": MACRO_DRUG,
    "Immunologic Factor": MACRO_DRUG,
    "Indicator, Reagent, or Diagnostic Aid": MACRO_DRUG,
    "Nucleic Acid, Nucleoside, or Nucleotide": MACRO_DRUG,
    "Organic Chemical": MACRO_DRUG,
    "Pharmacologic Substance": MACRO_DRUG,
    "Vitamin": MACRO_DRUG,
    "Diagnostic Procedure": PROCEDURE_TREATMENT,
    "Health Care Activity": PROCEDURE_TREATMENT,
    "Laboratory Procedure": PROCEDURE_TREATMENT,
    "Laboratory or Test Result": PROCEDURE_TREATMENT,
    "Medical Device": PROCEDURE_TREATMENT,
    "Therapeutic or Preventive Procedure": PROCEDURE_TREATMENT,
}

# Semantic type -> macro class, as used when building gold sets.
GOLD_CLASS = {
    "Disease or Syndrome": DISEASE_SYMPTOM,
    "Sign or Symptom": DISEASE_SYMPTOM,
    "Pathologic Function": DISEASE_SYMPTOM,
    "Neoplastic Process": DISEASE_SYMPTOM,
    "Mental or Behavioral Dysfunction": DISEASE_SYMPTOM,
    "Finding": DISEASE_SYMPTOM,
    "Therapeutic or Preventive Procedure": PROCEDURE_TREATMENT,
    "Diagnostic Procedure": PROCEDURE_TREATMENT,
    "Health Care Activity": PROCEDURE_TREATMENT,
    "Laboratory Procedure": PROCEDURE_TREATMENT,
    "Medical Device": PROCEDURE_TREATMENT,
    "Pharmacologic Substance": MACRO_DRUG,
    "Organic Chemical": MACRO_DRUG,
    "Clinical Drug": MACRO_DRUG,
    "Antibiotic": MACRO_DRUG,
    "Biomedical or Dental Material": MACRO_DRUG,
}

# Type name written by a generative tagger -> macro class.
GENERATED_TYPE_CLASS = {
    "SYMPTOM_AND_DISEASE": DISEASE_SYMPTOM,
    "SYMPTOM": DISEASE_SYMPTOM,
    "DISEASE": DISEASE_SYMPTOM,
    "CONDITION": DISEASE_SYMPTOM,
    "DRUG": MACRO_DRUG,
    "MEDICATION": MACRO_DRUG,
    "MEDICAL_PROCEDURE": PROCEDURE_TREATMENT,
    "PROCEDURE": PROCEDURE_TREATMENT,
    "TREATMENT": PROCEDURE_TREATMENT,
    "TEST": PROCEDURE_TREATMENT,
    "LAB": PROCEDURE_TREATMENT,
}

# Tag name in the source corpora -> macro class.
CORPUS_TAG_CLASS = {
    "ten_benh": DISEASE_SYMPTOM,
    "trieu_chung_benh": DISEASE_SYMPTOM,
    "nguyen_nhan_benh": DISEASE_SYMPTOM,
    "Symptom_and_Disease": DISEASE_SYMPTOM,
    "SYMPTOM_AND_DISEASE": DISEASE_SYMPTOM,
    "bien_phap_chan_doan": PROCEDURE_TREATMENT,
    "bien_phap_dieu_tri": PROCEDURE_TREATMENT,
    "DiagnosticProcedure": PROCEDURE_TREATMENT,
    "medical_procedure": PROCEDURE_TREATMENT,
    "drug": MACRO_DRUG,
}

# Tagger label -> final type, and the labels that retrieval decides.
TAGGER_TYPE = {
    "Drug": DRUG,
    "Medication": DRUG,
    "Chemical": DRUG,
    "Procedure": TEST_NAME,
    "Test": TEST_NAME,
    "Procedure/Treatment": TEST_NAME,
}
DISEASE_LABELS = ("Disease", "Disease/Symptom", "Condition")

# Macro class -> final type when training data is relabelled.
RELABEL_TYPE = {
    DISEASE_SYMPTOM: DIAGNOSIS,
    PROCEDURE_TREATMENT: TEST_NAME,
    MACRO_DRUG: DRUG,
}

# Source vocabulary -> code key.
VOCABULARY_KEY = {
    "ICD10": "icd10",
    "ICD10CM": "icd10",
    "ICD10PCS": "icd10",
    "ICD9CM": "icd9",
    "RXNORM": "rxnorm",
    "SNOMEDCT_US": "snomed",
    "LNC": "loinc",
    "LOINC": "loinc",
    "MSH": "mesh",
    "OMIM": "omim",
    "HPO": "hpo",
    "DRUGBANK": "drugbank",
    "PUBCHEM": "pubchem",
    "MEDLINE": "pubmed",
    "PMID": "pubmed",
    "PUBMED": "pubmed",
}

# Knowledge-graph labels and identifier columns.
KG_LABELS = ("Diagnosis", "Disease", "Phenotype")
SYMPTOM_KG_LABELS = ("Disease", "Phenotype")
KG_ID_COLUMNS = (
    "uml_id", "hpo_id", "mesh_id", "omim_id", "icd", "pubchem_id", "drugbank_id",
)
KG_NAMES_EN = ("name", "medgemma_trans", "qwen_trans", "map_trans")
KG_NAMES_VI = ("medgemma_trans", "qwen_trans", "map_trans", "name")

# Drug relations that name an ingredient.
INGREDIENT_RELATIONS = (
    "has_ingredient", "has_precise_ingredient", "tradename_of", "consists_of",
)

# Positions in the pipe-delimited concept and relation files.
CONCEPT_FIELDS = {"rxcui": 0, "lat": 1, "sab": 11, "tty": 12, "code": 13, "term": 14}
CONCEPT_MIN_FIELDS = 15
RELATION_FIELDS = {"rxcui1": 0, "rxcui2": 4, "rela": 7}
RELATION_MIN_FIELDS = 11

# BIO label lists of the two tagger families.
BIO_LABELS_VI = (
    "O", "B-Disease/Symptom", "I-Disease/Symptom", "B-Procedure/Treatment",
    "I-Procedure/Treatment", "B-Drug", "I-Drug",
)
BIO_LABELS_EN = ("O", "B-Disease", "I-Disease", "B-Chemical", "I-Chemical")
IGNORED_LABEL = -100

# Precomposed letters that mark Vietnamese text.
VIETNAMESE_LETTERS = (
    "àáãạảăắằẵặẳâấầẫậẩđèéẽẹẻêếềễệểìíĩịỉòóõọỏôốồỗộổơớờỡợởùúũụủưứừữựửỳýỹỵỷ"
)

# Instructions written into exported chat records.
EXTRACTION_PROMPT = (
    "Bạn là một chuyên gia y tế AI. Nhiệm vụ của bạn là trích xuất các thực thể y tế từ "
    "văn bản và trả về dưới dạng JSON list. Các loại thực thể hợp lệ bao gồm: "
    "Disease/Symptom, Procedure/Treatment, Drug. Kết quả trả về phải chứa entity (tên thực "
    "thể), type (loại thực thể), start_token và end_token (chỉ số của từ bắt đầu và kết "
    "thúc trong câu, bắt đầu từ 0)."
)
RELABEL_PROMPT = (
    "Bạn là một chuyên gia y tế AI. Nhiệm vụ của bạn là trích xuất các thực thể y tế từ "
    "văn bản và trả về dưới dạng JSON list. Các loại thực thể hợp lệ bao gồm: CHẨN_ĐOÁN, "
    "TRIỆU_CHỨNG, THUỐC, TÊN_XÉT_NGHIỆM, KẾT_QUẢ_XÉT_NGHIỆM. Kết quả trả về phải chứa "
    "entity (tên thực thể), type (loại thực thể), assertions (mảng các chuỗi như "
    "'isNegated', 'isHistorical'), start_token và end_token (chỉ số của từ bắt đầu và kết "
    "thúc trong câu, bắt đầu từ 0)."
)

# Characters treated as ASCII punctuation and ASCII whitespace.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ASCII_SPACE = " \t\n\r\x0b\x0c"

# Thresholds and weights.
LINK_FLOOR = 0.7
SCORING_LINK_FLOOR = 0.80
CANDIDATE_FLOOR = 0.5
DIAGNOSIS_FLOOR = 0.5
DRUG_FLOOR = 0.6
LEXICAL_WEIGHT = 0.5
RETRIEVED = 3
LABEL_PROBABILITY = 0.5
MIN_TERM_LENGTH = 3
MERGE_GAP = 1
CONTEXT_CHARS = 40
POSITIVE_PAIRS = 2500
SEED = 42
SPLIT_FRACTIONS = (0.8, 0.1)
SCORE_WEIGHTS = (0.3, 0.3, 0.4)


@dataclass(frozen=True)
class Rules:
    """Phrase lists and patterns used by the text rules (defaults: Vietnamese)."""

    # Numbered section headers.
    history_header: str = r"1\.\s+(?:Tiền sử bệnh|Tiền sử)"
    present_header: str = r"2\.\s+(?:Tiền sử bệnh hiện tại|Bệnh sử hiện tại)"
    hospital_header: str = r"3\.\s+Đánh giá tại bệnh viện"

    # Negation.
    negated_line_starts: tuple[str, ...] = ("- không", "không ")
    negators: tuple[str, ...] = ("không ", "chưa ", "phủ nhận ")
    blanked_phrases: tuple[str, ...] = ("không có", "không ghi nhận", "chưa ghi nhận")
    contrast_markers: tuple[str, ...] = (
        " nhưng ", " tuy nhiên ", ", có ", " lại có ", " kèm ", " và có ",
    )
    clause_breaks: tuple[str, ...] = (".", ";", "\n")

    # Precision filter.
    term_strip: str = " \t\r\n.,;:-()[]{}"
    short_terms: tuple[str, ...] = ("ho", "mủ", "u", "k")
    generic_terms: tuple[str, ...] = (
        "cảm thấy", "cảm giác", "khó chịu", "bất thường", "bình thường", "theo dõi",
    )
    generic_prefix: str = "cảm thấy "
    dose_only: str = r"\d+(?:[.,]\d+)?\s*(?:mg|g|mcg|ml|viên|ống|lọ|gói|iu|ui)"

    # Type correction.
    symptoms: tuple[str, ...] = (
        "khó thở", "buồn nôn", "đau ngực", "đau đầu", "đau bụng", "đau lưng",
        "tiêu chảy", "mệt mỏi", "chóng mặt", "sốt", "ho", "nôn", "đờm",
    )
    dose_after: str = (
        r"^\s*(?:\d+(?:[.,]\d+)?\s*)?(?:mg|g|mcg|ml|viên|ống|lọ|gói|iu|ui|đơn vị)\b"
    )
    drug_before: str = r"(?:thuốc|dùng|uống|sử dụng|điều trị)\s*$"
    test_phrases: tuple[str, ...] = ("phân tích", "xét nghiệm")
    test_names: tuple[str, ...] = ("ct", "mri", "x-quang", "xq")

    # Dose and frequency that follow a drug name (order matters).
    dose_tail: str = (
        r"^[\s\-]*(\d+(?:[.,]\d+)?\s*(?:mg|g|mcg|ml|viên|ống|lọ|gói|đơn vị|IU|UI|x\s*\d+|po"
        r"|bid|tid|qid|prn|giọt|lần|/|ngày|giờ|phút)[a-zA-Z0-9\s/]*)"
    )

    def but(self, **changes) -> "Rules":
        return replace(self, **changes)


VIETNAMESE = Rules()


def model_language(lang: str) -> str:
    """The model a language goes to: English has its own, the rest share one."""
    return "en" if lang == "en" else "vi"

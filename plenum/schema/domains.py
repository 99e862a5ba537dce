"""Closed value lists of the data model, checked by ``in_domain`` and ``to_domain``."""

# Fixed values, in the order of the data model.
DOMAINS = {
    "chamber_type": ("House", "Senate", "Joint"),
    "party_type": ("Democrat", "Republican", "Independent", "Independent Democrat"),
    "party_abbreviation_type": ("D", "R", "I", "ID"),
    "bill_type_enum": (
        "hr", "s", "hjres", "sjres", "hconres", "sconres",
        "hres", "sres", "pl", "stat", "usc", "srpt", "hrpt",
    ),
    "vote_method_type": (
        "recorded vote", "voice vote", "unanimous consent", "roll",
        "yea-and-nay", "2/3 yea-and-nay", "quorum call",
    ),
    "vote_cast_type": ("Yea", "Nay", "Present", "Not Voting", "Absent", "Candidate"),
    "vote_type_enum": (
        "Passage", "Conference Report", "Cloture", "Veto Override",
        "Amendment", "Committee", "Recommit", "Other", "Election",
    ),
    "member_type_enum": ("Representative", "Senator", "Delegate", "Resident Commissioner"),
    "text_version_code_type": (
        "IH", "IS", "RH", "RS", "RFS", "RFH", "EH", "ES", "ENR", "CPH", "CPS",
        "PCS", "PCH", "PL", "RDS", "RDH", "RTS", "RTH", "ATS", "ATH", "PP",
        "RCH", "EAS", "RIS", "EAH", "LTH", "LTS", "PRL", "RCS", "RIH",
    ),
    "format_type_enum": ("Formatted Text", "PDF", "Formatted XML"),
    "amendment_type_enum": ("hamdt", "samdt", "suamdt"),
    "committee_type_enum": (
        "Standing", "Special", "Select", "Joint", "Subcommittee", "Task Force",
    ),
    "committee_position_type": ("Chairman", "Ranking Member", "Vice Chairman", "Member"),
    "origin_chamber_code_type": ("H", "S"),
    "severity_type": ("High", "Medium", "Low"),
    "stance_direction_type": ("Progressive", "Conservative", "Neutral", "Bipartisan"),
    "analysis_status_type": ("in_progress", "completed", "failed"),
    "score_status_type": ("scored", "no_overlap"),
    "user_stance_type": ("support", "oppose", "neutral"),
    "processing_status_type": ("success", "failed", "skipped"),
    "processing_entity_type": ("bill", "vote", "member", "amendment", "analysis", "score"),
    "error_class_type": ("Transient", "Systemic"),
    "workflow_status_type": (
        "pending", "running", "completed", "completed_with_errors", "failed",
    ),
    "amendment_text_version_code_type": ("SUB", "MOD"),
    "legislation_type_enum": ("BILL", "AMENDMENT"),
    "sponsor_type_enum": ("member", "committee"),
    "concept_effect": ("EXPANDS", "RESTRICTS", "CREATES", "ELIMINATES", "MODIFIES", "REPORTS"),
    "concept_impact": ("POSITIVE", "NEGATIVE", "MIXED", "NEUTRAL"),
    "concept_scope": ("MAJOR", "MODERATE", "MINOR"),
    "taxonomy_status": ("proposed", "active"),
    "decomposition_status": ("running", "completed", "completed_with_errors", "failed"),
}

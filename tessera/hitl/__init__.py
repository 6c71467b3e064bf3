"""People in the loop: monitoring, explanation, triage, repair, lineage."""

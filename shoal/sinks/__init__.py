"""Reports: JSON, SARIF, HTML, text, rewritten workflows."""

"""Training-data operators: language, toxicity, quality, duplicates, leaks, licences, mixing and file formats."""

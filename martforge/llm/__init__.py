"""Training-data operators: quality scoring, token files, license scans,
decontamination, duplicate search, source mixing, token counts, chat
formatting, exact vector search and set joins."""

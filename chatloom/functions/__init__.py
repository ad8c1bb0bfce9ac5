"""Column functions: text rules, prompts, token counts and distribution scores."""

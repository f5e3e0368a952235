"""Part of tabulon; see the README for what each module holds."""

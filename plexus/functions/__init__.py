"""Column functions: text forms, score normalizers, exact tests."""

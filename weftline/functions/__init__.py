"""Column functions: normalizers, pretokenizers, arrays of ids, decoding."""

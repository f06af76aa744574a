"""Where reads come from: FASTQ files and table-derived reads."""

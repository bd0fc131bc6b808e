"""spark-submit entry: ``spark-submit --py-files shelfwise.zip run_job.py <job> --warehouse ... --as-of ... --out ...``

See ``python -m shelfwise --help`` for the jobs and options.
"""

from shelfwise.__main__ import main

if __name__ == "__main__":
    main()

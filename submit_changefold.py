"""Entry script for spark-submit: ``spark-submit --py-files changefold.zip submit_changefold.py <command> ...``."""

from changefold.cli import main

if __name__ == "__main__":
    main()
